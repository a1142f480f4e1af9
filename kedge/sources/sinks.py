"""Results as files and texts: rows of occurrences, XML, JSON, annotated HTML, turtle, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kedge.functions.scalars import alternatives, full_uri, nt_escape
from kedge.operators.skew import numbered, salted_join


def occurrence_line(types: str | None = None) -> Column:
    """id, uri, form, context with blanks collapsed, offset[, types]: one line of an occurrence file. Nulls become empty fields."""
    cols = [F.col("id"), F.col("uri"), F.col("surface_form"), F.regexp_replace("context", "\\s+", " "), F.col("text_offset").cast("string")]
    if types:
        cols.append(F.array_join(types, ","))
    return F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cols])


def write_occurrences(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.select(occurrence_line().alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A model table as Parquet."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def write_quoted_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quoteAll", "true").option("header", "true").csv(path)


def escape_xml(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def annotation_json(links: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): the links of each text as one JSON array, by offset. A text's links are bounded by the text."""
    one = F.struct(F.col("start").alias("offset"), F.col("name").alias("surfaceForm"), F.col("uri").alias("URI"), F.col("support"), F.format_string("%.6f", F.round("final_score", 6)).alias("similarityScore"))
    return links.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


def annotation_xml(links: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, xml): <Annotation> with one <Resource> per link, by offset."""
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), escape_xml(c.cast("string")), F.lit('"'))
    one = F.concat(F.lit("<Resource"), attribute("URI", F.col("uri")), attribute("support", F.col("support")), attribute("surfaceForm", F.col("name")), attribute("offset", F.col("start")), F.lit("/>"))
    sorted_links = F.array_sort(F.collect_list(F.struct("start", one.alias("x"))))
    return links.groupBy(key).agg(F.concat(F.lit("<Annotation><Resources>"), F.array_join(F.transform(sorted_links, lambda s: s["x"]), ""), F.lit("</Resources></Annotation>")).alias("xml"))


def annotated_html(docs: DataFrame, links: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, html): the text with its links as <a>, spliced in from the left; texts without links stay as they are."""
    grouped = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", F.char_length("name").alias("length"), "name", full_uri(F.col("uri")).alias("iri")))).alias("ls"))
    rows = docs.select(key, text).join(grouped, key, "left")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        link = F.concat(before, F.lit('<a href="'), s["iri"], F.lit('">'), s["name"], F.lit("</a>"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((s["start"] + s["length"]).alias("at"), F.concat(acc["out"], F.array(link)).alias("out")))

    done = F.aggregate("ls", zero, step)
    html = F.concat(F.array_join(done["out"], ""), F.substr(F.col(text), done["at"] + 1))
    return rows.select(key, F.when(F.col("ls").isNull(), F.col(text)).otherwise(html).alias("html"))


def turtle_lines(links: DataFrame, key: str = "doc_id", base: str = "http://kb.example/text/") -> DataFrame:
    """(key, line): one turtle statement per link with begin and end index, mention and identity."""
    begin, end = F.col("start").cast("string"), (F.col("start") + F.char_length("name")).cast("string")
    line = F.concat(
        F.lit(f"<{base}"), F.col(key).cast("string"), F.lit("#char="), begin, F.lit(","), end, F.lit('> nif:beginIndex "'), begin, F.lit('" ; nif:endIndex "'), end,
        F.lit('" ; nif:anchorOf "'), nt_escape(F.col("name")), F.lit('" ; itsrdf:taIdentRef <'), full_uri(F.col("uri")), F.lit("> ."),
    )
    return links.select(key, line.alias("line"))


def name_triples(pairs: DataFrame, predicate: str = "http://www.w3.org/2000/01/rdf-schema#label") -> DataFrame:
    """(line): one N-Triples line per name of a resource."""
    return pairs.select(F.concat(F.lit("<"), full_uri(F.col("uri")), F.lit(f'> <{predicate}> "'), nt_escape(F.col("name")), F.lit('" .')).alias("line"))


def score_quads(lex: DataFrame, least: int = 5) -> DataFrame:
    """(line): name, resource and pointwise mutual information of pairs seen often enough."""
    rows = lex.filter(F.col("n") >= least)
    return rows.select(F.concat(F.lit("<"), full_uri(F.col("uri")), F.lit('> <http://kb.example/score/pmi> "'), F.format_string("%.6f", F.round("pmi", 6)), F.lit('" "'), nt_escape(F.col("name")), F.lit('" .')).alias("line"))


def inverted_index(occs: DataFrame, key: str = "occ_id") -> DataFrame:
    """(uri, field, position, value, n): what an index document of a resource holds, a row per entry and never one row per
    resource: its distinct surface forms with their counts (position null), and its contexts in order."""
    forms = occs.filter(F.col("uri").isNotNull() & F.col("surface_form").isNotNull()).groupBy("uri", F.col("surface_form").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    contexts = numbered(occs.filter(F.col("uri").isNotNull() & F.col("context").isNotNull()).select(key, "uri", "context"), "uri", key)
    return forms.select("uri", F.lit("surface_form").alias("field"), F.lit(None).cast("long").alias("position"), "value", "n").unionByName(
        contexts.select("uri", F.lit("context").alias("field"), F.col("position").cast("long").alias("position"), F.col("context").alias("value"), F.lit(1).cast("long").alias("n"))
    )


def merged_contexts(occs: DataFrame, key: str = "occ_id") -> DataFrame:
    """(uri, position, surface_form, context), sorted by uri: the contexts of every resource in order of occurrence, one a row."""
    rows = occs.filter(F.col("uri").isNotNull() & F.col("context").isNotNull()).select(key, "uri", "surface_form", "context")
    return numbered(rows, "uri", key).select("uri", "position", "surface_form", "context").orderBy("uri", "position")


def compressed_index(occs: DataFrame, least: int) -> DataFrame:
    """(uri, uri_count, n_contexts): the documents of resources named often enough, without their stored fields."""
    counts = occs.filter(F.col("uri").isNotNull()).groupBy("uri").agg(F.count(F.lit(1)).alias("uri_count"), F.count("context").alias("n_contexts"))
    return counts.filter(F.col("uri_count") >= least)


def error_xml(message: Column, status: Column) -> Column:
    """One error document; a null message is empty."""
    return F.concat(F.lit('<error status="'), status.cast("string"), F.lit('">'), escape_xml(F.coalesce(message, F.lit(""))), F.lit("</error>"))


def topic_json(topics: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): the topics of each text with their probabilities, the likeliest first."""
    one = F.struct((-F.col("p")).alias("m"), "topic", F.format_string("%.6f", F.round("p", 6)).alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["topic"].alias("topic"), x["p"].alias("p")))
    return topics.groupBy(key).agg(F.to_json(listed).alias("json"))


def topic_xml(topics: DataFrame, key: str = "doc_id") -> DataFrame:
    one = F.concat(F.lit('<topic name="'), escape_xml(F.col("topic")), F.lit('" score="'), F.format_string("%.6f", F.round("p", 6)), F.lit('"/>'))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("m"), "topic", one.alias("x")))), lambda x: x["x"])
    return topics.groupBy(key).agg(F.concat(F.lit("<topics>"), F.array_join(listed, ""), F.lit("</topics>")).alias("xml"))


def candidates_xml(candidates: DataFrame) -> DataFrame:
    """(name, xml): each name with its candidates, the most frequent first."""
    one = F.concat(F.lit('<resource uri="'), escape_xml(F.col("uri")), F.lit('" support="'), F.col("support").cast("string"), F.lit('" priorScore="'), F.format_string("%.6f", F.round("prior", 6)), F.lit('"/>'))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("prior")).alias("m"), "uri", one.alias("x")))), lambda x: x["x"])
    return candidates.groupBy("name").agg(F.concat(F.lit('<surfaceForm name="'), escape_xml(F.col("name")), F.lit('">'), F.array_join(listed, ""), F.lit("</surfaceForm>")).alias("xml"))


def text_annotations(links: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, begin, end, uri, score): links as typed stretches of text, as annotation frameworks take them."""
    return links.select(key, F.col("start").cast("long").alias("begin"), (F.col("start") + F.char_length("name")).cast("long").alias("end"), "uri", F.col("final_score").alias("score"))


def separate_documents(occs: DataFrame) -> DataFrame:
    """(occ_id, uri, surface_form, context): an index document per occurrence, the form in lower case."""
    kept = occs.filter(F.col("uri").isNotNull() & F.col("surface_form").isNotNull() & F.col("context").isNotNull())
    return kept.select("occ_id", "uri", F.lower("surface_form").alias("surface_form"), "context")


def candidate_index(pairs: DataFrame, more_than: int = 0) -> DataFrame:
    """(uri, name, n): names by which a resource is found, those seen often enough, with their alternatives (once, by the largest count)."""
    kept = pairs.filter(F.col("n") > more_than)
    return kept.select("uri", F.explode(alternatives(F.col("name"))).alias("name"), "n").groupBy("uri", "name").agg(F.max("n").alias("n"))


def enriched(index: DataFrame, counts: DataFrame, types: DataFrame) -> DataFrame:
    """Index documents (uri, …) with the resource's support and types; a resource without them has 0 and none."""
    c = counts.select(F.col("uri").alias("__c"), F.col("support"))
    t = types.select(F.col("uri").alias("__t"), F.col("types"))
    got = salted_join(salted_join(index, c, "uri", "__c", "left"), t, "uri", "__t", "left").drop("__c", "__t")
    return got.withColumn("support", F.coalesce("support", F.lit(0))).withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def page_line() -> Column:
    """uri TAB text with blanks collapsed: one line of a page file."""
    return F.concat_ws("\t", "uri", F.regexp_replace("text", "\\s+", " "))
