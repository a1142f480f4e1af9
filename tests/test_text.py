from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kedge.functions import scalars as S
from kedge.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_uri_names_and_keywords(spark):
    cases = {"Huge": ("Huge", '+"Huge"'), "Huge_(TV_series)": ("Huge", '+"Huge" +"TV series"'), "Huge_cardinal": ("Huge cardinal", '+"Huge cardinal"'), "Apple_(disambiguation)": ("Apple", '+"Apple"'), "Apple_%28disambiguation%29": ("Apple", '+"Apple"')}
    for uri, want in cases.items():
        assert (one(spark, S.surface_form_of(F.col("u")), u=uri), one(spark, S.keywords_of(F.col("u")), u=uri)) == want


def test_types(spark):
    assert one(spark, S.type_of_qname(F.col("u")), u="f:/location") == one(spark, S.type_of_uri(F.col("u")), u="http://rdf.freebase.com/ns/location")
    assert one(spark, S.type_of_qname(F.col("u")), u="Schema:Place") == "Schema:Place"
    assert one(spark, S.types_of_csv(F.col("u")), u=" d:A, ,s:B") == ["DBpedia:A", "Schema:B"]


def test_stems():
    assert [T.stem(w) for w in ("buying", "ponies", "caresses", "hopping", "hoped", "relational", "generously", "sky", "ties", "agreed")] == ["buy", "poni", "caress", "hop", "hope", "relat", "generous", "sky", "tie", "agre"]


def test_spans_point_into_the_text(spark):
    long = "Ab, cd! " * 5000
    texts = ["", "one", "  two-three  ", "émile 😀 x", long]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, text string")
    got = T.token_spans(df, "id", "text").collect()
    assert all(texts[r["id"]][r["start"] : r["start"] + len(r["token"])] == r["token"] for r in got)
    assert sum(r["id"] == 4 for r in got) == 10000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-50, 5), min_size=1, max_size=6))
def test_log_sum(spark, xs):
    import math

    df = spark.createDataFrame([(xs,)], "a array<double>")
    got = df.select(S.ln_sum_over(F.col("a")).alias("x"), F.aggregate("a", F.lit(float("-inf")), S.ln_sum).alias("y")).first()
    want = math.log(sum(math.exp(x) for x in xs))
    assert abs(got["x"] - want) < 1e-9 and abs(got["y"] - want) < 1e-9


def test_log_zero(spark):
    assert one(spark, S.ln(F.col("v")), v=0.0) == float("-inf")
    assert one(spark, S.ln_product(S.ln(F.col("v")), F.lit(1.0)), v=0.0) == float("-inf")


def test_escapes_and_acronyms(spark):
    assert one(spark, S.nt_escape(F.col("u")), u='a"é😀\n') == 'a\\"\\u00E9\\U0001F600\\n'
    assert one(spark, S.is_acronym_of(F.col("a"), F.col("b")), a="BBC", b="British Broadcasting Corporation") is True
    assert one(spark, S.is_acronym_of(F.col("a"), F.col("b")), a="BXC", b="British Broadcasting Corporation") is False


def test_markup_mentions(spark):
    df = spark.createDataFrame([("see [[Ab]] and [[Cd]].",), ("none",), (None,)], "t string")
    plain, marks = T.mentions_in_brackets(F.col("t"))
    got = df.select(plain.alias("p"), marks.alias("m")).collect()
    assert got[0]["p"] == "see Ab and Cd." and [(m["name"], m["offset"]) for m in got[0]["m"]] == [("Ab", 4), ("Cd", 11)]
    assert got[1]["m"] == [] and got[2]["p"] is None
    links = spark.createDataFrame([("[[u|n|0.5]] [[v]]",)], "t string").select(T.wiki_links(F.col("t")).alias("l")).first()["l"]
    assert [tuple(x) for x in links] == [("u", "n", 0.5), ("v", "v", None)]
