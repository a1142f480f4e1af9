"""Queries over names in any script and with any sign, against plain Python on a small fixture."""

import json
from collections import Counter

import pytest

import __spark_entry__ as entry

NAMES = ["Émile Zola", "Emile Zola", "Москва река", "Moscow's", 'Say "Hi"', "Ab​cdefghij", "Zürich, CH", "Zürich", None]
KNOWN = ["émile zola", "Émile Zole", "Москва Река", "moscow's", "Abcdefghij", "Ab​cdefghik", "zürich", "Zurich"]
URIS = ["Émile_Zola", "A'b", "A.b", "Plain_(x)"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    occs = [(i, f"P{i}-p1l1", URIS[i % 4], n, f"see {n} here", 4) for i, n in enumerate(NAMES * 2)]
    spark.createDataFrame(occs, "occ_id long, id string, uri string, surface_form string, context string, text_offset int").write.parquet(f"{d}/occs.parquet")
    spark.createDataFrame([(i, n, 5, 9) for i, n in enumerate(KNOWN)], "sf_id long, name string, annotated_count int, total_count int").write.parquet(f"{d}/surface_forms.parquet")
    spark.createDataFrame([(u, 1, 40, None) for u in URIS], "uri string, slice_id long, uri_count long, types string").write.parquet(f"{d}/dbpediaresource.parquet")
    return d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def escape(t):
    named = {'"': '\\"', "\\": "\\\\"}
    return "".join(named.get(c) or (c if " " <= c <= "~" else f"\\u{ord(c):04X}") for c in t)


def of(spark, d, name):
    return [tuple(r) for r in entry.queries()[name](spark, d).collect()]


FORMS = {n for n in NAMES if n}


def grams(t):
    return [t.lower()[i : i + 3] for i in range(len(t) - 2)]


def test_names_in_any_script_are_compared(spark, small):
    pairs = lambda t: {f"^{t.lower()}$"[i : i + 2] for i in range(len(t) + 1)}
    near = lambda a, b: len(pairs(a) & pairs(b)) >= 2 and abs(len(a) - len(b)) * 2 <= max(len(a), len(b))
    alike = {(a, b): 1 - distance(a.lower(), b.lower()) / max(len(a), len(b)) for a in FORMS for b in KNOWN if near(a, b)}
    assert {(a, b): round(x, 9) for a, b, x in of(spark, small, "e09_fuzzy_names")} == {k: round(v, 9) for k, v in alike.items() if v >= 0.5}
    shared = {(a, b): len(set(grams(a)) & set(grams(b))) for a in FORMS for b in KNOWN}
    assert {(a, b): n for a, b, n in of(spark, small, "e10_trigram_names")} == {k: n for k, n in shared.items() if n >= 6}
    score = lambda a, b: 1.0 if a == b else 0.85 if a.lower() == b.lower() else 0.85 * (1 - distance(a, b) / max(len(a), len(b)))
    want = {(a, b): round(score(a, b), 9) for (a, b), n in shared.items() if n >= 6}
    assert {(a, b): round(x, 9) for a, b, x in of(spark, small, "i17_edit_scores")} == want and any(v not in (1.0, 0.85) for v in want.values())
    assert dict(of(spark, small, "c17_char_trigrams")) == Counter(g for a in FORMS for g in grams(a))


def test_names_and_uris_with_any_sign_are_written(spark, small):
    pairs = {(URIS[i % 4], n, i) for i, n in enumerate(NAMES * 2) if n}
    iri = dict(of_uris(spark))
    want = [f'<http://kb.example/text/{i}#char=4,{4 + len(n)}> nif:beginIndex "4" ; nif:endIndex "{4 + len(n)}" ; nif:anchorOf "{escape(n)}" ; itsrdf:taIdentRef <{iri[u]}> .' for u, n, i in pairs]
    assert sorted(x for (x,) in of(spark, small, "b10_turtle")) == sorted(want)
    want = {f'<{iri[u]}> <http://www.w3.org/2000/01/rdf-schema#label> "{escape(n)}" .' for u, n, _ in pairs}
    assert sorted(x for (x,) in of(spark, small, "b16_name_triples")) == sorted(want)
    got = {n: [(c["uri"], c["n"]) for c in json.loads(t)] for n, t in of(spark, small, "b07_nested_candidates")}
    assert {u for cs in got.values() for u, _ in cs} == set(URIS) and set(got) == FORMS
    counts = Counter((n, u) for u, n, _ in pairs)
    assert {(n, u): k for n, cs in got.items() for u, k in cs} == counts


def of_uris(spark):
    from pyspark.sql import functions as F

    from kedge.functions.scalars import full_uri

    return [tuple(r) for r in spark.createDataFrame([(u,) for u in URIS], "u string").select("u", full_uri(F.col("u"))).collect()]
