"""Readers of the text formats around the model: occurrence files, triples, gold corpora, topic files, feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge.functions import text as T
from kedge.functions.scalars import is_acronym_of
from kedge.sources.occurrence_lines import loaded, read_occurrence_lines


def occurrence_files(spark: SparkSession, path: str) -> DataFrame:
    """Typed occurrences of TSV files (compressed ones too); lines that can't be loaded are dropped, see occurrence_lines."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.input_file_name().alias("file_name"), F.col("value").alias("line"))
    return loaded(read_occurrence_lines(lines))


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """(uri, text) of two-column TSV files; a wrong number of columns is an error."""
    return spark.read.schema("uri string, text string").option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)


def triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o) of N-Triples lines; comments and lines with fewer than four parts are skipped, literals keep their text."""
    pattern = '^\\s*<([^>]*)>\\s+<([^>]*)>\\s+(?:<([^>]*)>|"((?:[^"\\\\]|\\\\.)*)"[^\\s]*)\\s*(?:<[^>]*>)?\\s*\\.\\s*$'
    part = lambda i: F.regexp_extract(column, pattern, i)
    rows = lines.filter(F.col(column).rlike(pattern))
    return rows.select(part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(part(4)).alias("o"))


def types_by_triples(rows: DataFrame) -> DataFrame:
    """(uri, types) of rdf:type statements."""
    is_type = F.col("p").isin("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "rdf:type")
    return rows.filter(is_type).groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set("o")).alias("types"))


def common_words(lines: DataFrame, more_than: int, less_than: int | None = None, column: str = "value") -> DataFrame:
    """(word, n) of a frequency list 'rank TAB word TAB count'."""
    parts = F.split(column, "\t")
    n = F.try_element_at(parts, F.lit(3)).try_cast("long")
    rows = lines.select(F.try_element_at(parts, F.lit(2)).alias("word"), n.alias("n")).filter(F.col("n") > more_than)
    return rows.filter(F.col("n") < less_than) if less_than is not None else rows


def bracket_gold(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, uri, name, confidence) of gold texts with [[uri|name|confidence]]."""
    return df.select(key, F.explode(T.wiki_links(F.col(text))).alias("l")).select(key, "l.uri", "l.name", "l.confidence")


def blocks_gold(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, sentence, start, end, label, uri): a text line, then 'start TAB end TAB label TAB uri' lines, a blank line ends the block."""
    block = df.select(key, F.posexplode(F.split(text, "\n[ \t]*\n")).alias("block", "b")).select(key, "block", F.split(F.btrim("b", F.lit("\n")), "\n").alias("ls"))
    mark = block.select(key, "block", F.col("ls")[0].alias("sentence"), F.explode(F.slice("ls", 2, 1_000_000)).alias("m"))
    p = F.split("m", "\t")
    return mark.select(key, "block", "sentence", F.try_element_at(p, F.lit(1)).try_cast("int").alias("start"), F.try_element_at(p, F.lit(2)).try_cast("int").alias("end"), F.try_element_at(p, F.lit(3)).alias("label"), F.try_element_at(p, F.lit(4)).alias("uri")).filter(F.col("start").isNotNull())


def column_gold(lines: DataFrame, key: str = "file", order: str = "line_no", column: str = "value") -> DataFrame:
    """(key, doc, start, name, uri): token TAB B/I TAB name TAB uri lines; '-DOCSTART-' opens a document, unlinked mentions have no uri.

    A file is read by one task in the order of its lines; its tokens are joined with blanks, but not before closing punctuation.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, part in f.groupby(key, sort=False):
                doc, at, last = -1, 0, None
                for line in part.sort_values(order)[column]:
                    cells = (line or "").split("\t")
                    if cells[0].startswith("-DOCSTART-"):
                        doc, at, last = doc + 1, 0, None
                        continue
                    if not cells[0]:
                        last = None
                        continue
                    at += at > 0 and cells[0] not in (".", ",", ";", ":", "!", "?", ")", "'s")
                    if len(cells) >= 3 and cells[1] == "B":
                        uri = cells[3] if len(cells) > 3 and not cells[3].startswith("--") else None
                        last = [k, doc, at, cells[2], uri]
                        out.append(last)
                    at += len(cells[0])
            yield pd.DataFrame(out, columns=[key, "doc", "start", "name", "uri"])

    kind = dict(lines.dtypes)[key]
    return lines.repartition(key).mapInPandas(read, f"{key} {kind}, doc int, start int, name string, uri string")


def xml_spots(text: Column) -> Column:
    """Array of (name, offset) of <annotation text=…><surfaceForm name=… offset=…/></annotation>."""
    names = F.xpath(text, F.lit("//surfaceForm/@name"))
    offsets = F.xpath(text, F.lit("//surfaceForm/@offset"))
    return F.transform(F.arrays_zip(names.alias("n"), offsets.alias("o")), lambda x: F.struct(x["n"].alias("name"), x["o"].try_cast("int").alias("offset")))


def anchors(html: Column) -> Column:
    """Array of (href, name) of the anchors of a page."""
    href = F.regexp_extract_all(html, F.lit("<a [^>]*href=[\"']([^\"']*)[\"'][^>]*>([^<]*)</a>"), F.lit(1))
    name = F.regexp_extract_all(html, F.lit("<a [^>]*href=[\"']([^\"']*)[\"'][^>]*>([^<]*)</a>"), F.lit(2))
    return F.arrays_zip(href.alias("href"), name.alias("name"))


def topic_descriptions(xml: DataFrame, column: str = "value") -> DataFrame:
    """(topic, categories, iptc, feeds) of topic description elements."""
    get = lambda path: F.xpath(column, F.lit(path))
    return xml.select(F.xpath_string(column, F.lit("/topic/@name")).alias("topic"), F.split(F.xpath_string(column, F.lit("/topic/categories")), ",\\s*").alias("categories"), get("/topic/iptc/@mediatopic").alias("iptc"), get("/topic/feed/@url").alias("feeds"))


def form_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, annotated, total) of a plain list of forms, one a line: counts are 0, repeated and null lines count once and not at all."""
    return lines.filter(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().select("name", F.lit(0).alias("annotated"), F.lit(0).alias("total"))


def candidate_map(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, uri, n) of lines 'count uri TAB form'; other lines are skipped."""
    pattern = "(?s)^\\s*([0-9]+) ([^\t]*)\t(.*)$"
    rows = lines.filter(F.col(column).rlike(pattern))
    return rows.select(F.regexp_extract(column, pattern, 3).alias("name"), F.regexp_extract(column, pattern, 2).alias("uri"), F.regexp_extract(column, pattern, 1).cast("long").alias("n"))


def disambiguation_items(pages: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, line, uri, name): of each list line of a page the first link, if its target contains the page's title or the
    title is an acronym of its name. Pages without list lines, and null ones, give nothing."""
    rows = pages.filter(F.col(title).isNotNull() & F.contains(text, F.lit("[["))).select(key, F.lower(F.trim(F.translate(title, "_", " "))).alias("__t"), F.posexplode(F.split(text, "\n")).alias("line", "l"))
    links = rows.filter(F.col("l").rlike("^ *[*#-] *.*\\[\\[[^\\[\\]]*\\]\\]")).select(key, F.col("line").cast("long").alias("line"), "__t", T.wiki_links(F.col("l"))[0].alias("x"))
    got = links.select(key, "line", "__t", "x.uri", "x.name")
    return got.filter(F.contains(F.lower(F.translate("uri", "_", " ")), F.col("__t")) | is_acronym_of(F.col("__t"), F.col("name"))).drop("__t")


def web_occurrences(pages: DataFrame, key: str, html: str, shortest: int = 50, longest: int = 500, longest_name: int = 40) -> DataFrame:
    """(key, href, name, text): anchors as occurrences, in texts of a fit length in which the anchor's name stands once."""
    rows = pages.filter(F.contains(html, F.lit("<a "))).select(key, F.regexp_replace(html, "<[^>]*>", "").alias("text"), F.explode(anchors(F.col(html))).alias("a"))
    got = rows.select(key, "a.href", "a.name", "text").filter(F.char_length("text").between(shortest, longest) & F.char_length("name").between(1, longest_name))
    return got.filter(F.char_length("text") - F.char_length(F.replace("text", F.col("name"), F.lit(""))) == F.char_length("name"))


def standoff_gold(annotations: DataFrame, texts: DataFrame, column: str = "value") -> DataFrame:
    """(doc, uri, start, name): stand-off annotation XML (docName, wikiName, offset, length) met with its texts (doc, text)."""
    get = lambda tag: F.xpath(column, F.lit(f"/annotations/annotation/{tag}/text()"))
    each = F.arrays_zip(get("docName").alias("doc"), get("wikiName").alias("uri"), get("offset").alias("start"), get("length").alias("n"))
    rows = annotations.select(F.explode(each).alias("a")).select("a.doc", "a.uri", F.col("a.start").try_cast("int").alias("start"), F.col("a.n").try_cast("int").alias("n"))
    return rows.join(texts, "doc").select("doc", "uri", "start", F.substr(F.col("text"), F.col("start") + 1, F.col("n")).alias("name"))


def linking_queries(queries: DataFrame, answers: DataFrame, docs: DataFrame, column: str = "value") -> DataFrame:
    """(query_id, name, doc, uri): query XML with answer lines 'id TAB uri TAB type' and the documents asked about; an answer that begins with NIL is none."""
    get = lambda path: F.xpath_string(column, F.lit(path))
    asked = queries.select(get("/kbpentlink/query/@id").alias("query_id"), get("/kbpentlink/query/name").alias("name"), get("/kbpentlink/query/docid").alias("doc"))
    parts = F.split(column, "\t")
    given = answers.select(parts[0].alias("query_id"), parts[1].alias("uri")).select("query_id", F.when(~F.startswith("uri", F.lit("NIL")), F.col("uri")).alias("uri"))
    return asked.join(given, "query_id", "left").join(docs.select("doc"), "doc", "left_semi").select("query_id", "name", "doc", "uri")


def spot_dataset(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, start, text, uri, valid) of lines with seven columns, the last t for a valid spot; lines with fewer are skipped."""
    p = F.split(column, "\t")
    rows = lines.filter(F.size(p) >= 7)
    return rows.select(p[0].alias("name"), p[1].try_cast("int").alias("start"), p[2].alias("text"), p[3].alias("uri"), (p[6] == "t").alias("valid"))
