import gzip

from kedge.sources import bags, readers, sinks
from kedge.streaming import feeds


def test_occurrence_files_round_trip(spark, tmp_path):
    rows = [("i1", "u", "Ab", "an  Ab\tx", 4), ("i2", "v", "Cd", "Cd", 0)]
    df = spark.createDataFrame(rows, "id string, uri string, surface_form string, context string, text_offset int")
    sinks.write_occurrences(df, str(tmp_path / "o"))
    got = {r["id"]: r for r in readers.occurrence_files(spark, str(tmp_path / "o")).collect()}
    assert set(got) == {"i2"}  # collapsed blanks moved the first form off its offset
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write("i\tu\tAb\tan Ab\t3\nbroken line\n")
    assert [r["context"] for r in readers.occurrence_files(spark, str(tmp_path / "x.tsv.gz")).collect()] == ["an Ab"]


def test_triples(spark):
    lines = spark.createDataFrame([("# no",), ("<s> <p> <o> .",), ('<s> <rdf:type> "a \\" b"@en .',), ("<s> <p>",)], "value string")
    got = readers.triples(lines)
    assert [tuple(r) for r in got.collect()] == [("s", "p", "o"), ("s", "rdf:type", 'a \\" b')]
    assert readers.types_by_triples(got).first()["types"] == ['a \\" b']


def test_gold_formats(spark):
    lines = ["-DOCSTART- (1 X)", "The", "EU\tB\tEU\tEuropean_Union", "rejects\t", "German\tB\tGerman\t--NME--", ".", "", "-DOCSTART- (2)", "Peter\tB\tPeter Blackburn\tP_B", "Blackburn\tI\tPeter Blackburn\tP_B"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    got = [tuple(r) for r in readers.column_gold(df).orderBy("doc", "start").collect()]
    assert got == [("f", 0, 4, "EU", "European_Union"), ("f", 0, 15, "German", None), ("f", 1, 0, "Peter Blackburn", "P_B")]
    text = spark.createDataFrame([(1, "took a pill\n7\t11\tdrug\tPill\n\nnone here\n")], "id long, t string")
    assert [tuple(r)[2:] for r in readers.blocks_gold(text, "id", "t").collect()] == [("took a pill", 7, 11, "drug", "Pill")]
    marks = spark.createDataFrame([(1, "a [[u|n|0.9]] b")], "id long, t string")
    assert [tuple(r) for r in readers.bracket_gold(marks, "id", "t").collect()] == [(1, "u", "n", 0.9)]


def test_xml_and_words(spark):
    x = spark.createDataFrame([('<annotation text="t"><surfaceForm name="Ab" offset="3"/></annotation>',)], "value string")
    assert [tuple(s) for s in x.select(readers.xml_spots(x["value"]).alias("s")).first()["s"]] == [("Ab", 3)]
    w = spark.createDataFrame([("1\tder\t900",), ("2\thaus\t50",), ("bad",)], "value string")
    assert [r["word"] for r in readers.common_words(w, 100).collect()] == ["der"]
    t = spark.createDataFrame([('<topic name="sport"><categories>A, B</categories><iptc mediatopic="1"/><feed url="http://f.example"/></topic>',)], "value string")
    assert tuple(readers.topic_descriptions(t).first()) == ("sport", ["A", "B"], ["1"], ["http://f.example"])


def test_bags(spark):
    ctx = spark.createDataFrame([("u", "a", 3), ("u", "b", 1), ("v", "a", 2)], "uri string, token string, n long")
    for write, parse in ((bags.write_pig, bags.parse_pig), (bags.write_json, bags.parse_json)):
        assert {tuple(r) for r in parse(write(ctx)).collect()} == {tuple(r) for r in ctx.collect()}
        assert {tuple(r) for r in parse(write(ctx), 2).collect()} == {("u", "a", 3), ("v", "a", 2)}
    assert {tuple(r) for r in bags.parse_pig(bags.write_pig(ctx), 2, strict=True).collect()} == {("u", "a", 3)}


def test_html_and_json(spark):
    docs = spark.createDataFrame([(1, "see Ab & Cd."), (2, "none")], "doc_id long, text string")
    links = spark.createDataFrame([(1, 4, "Ab", "A_b", 3, 0.5), (1, 9, "Cd", "C", 4, 0.25)], "doc_id long, start int, name string, uri string, support long, final_score double")
    html = {r["doc_id"]: r["html"] for r in sinks.annotated_html(docs, links).collect()}
    assert html == {1: 'see <a href="http://kb.example/resource/A_b">Ab</a> & <a href="http://kb.example/resource/C">Cd</a>.', 2: "none"}
    assert '"offset":4' in sinks.annotation_json(links).first()["json"]
    assert sinks.annotation_xml(links).first()["xml"].startswith("<Annotation><Resources><Resource URI=")


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, "2025-01-01 00:00:00"), (0, "2025-01-01 00:00:00")], "id long, at string").selectExpr("id", "to_timestamp(at) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "s.parquet"))
    stream = feeds.replay(spark, str(tmp_path / "s.parquet"))
    assert sorted(r["id"] for r in feeds.collected(feeds.new_items(stream, "id", "at")).collect()) == [0, 1, 2]
    seen = []
    feeds.run(stream, lambda df, n: seen.append(df.count()))
    assert sum(seen) == 6
    reg = feeds.Registry()
    reg.add("a", stream)
    assert list(reg.with_columns("id")) == ["a"] and reg.with_columns("nope") == {}
