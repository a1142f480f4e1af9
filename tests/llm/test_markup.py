import pytest

from kedge.llm import markup as m

PLAIN = [
    "Tickets cost $4 or $9 at the door.", "The ratio was 3 < 5 and later 7 > 2.", "The path C:\\maps\\new was empty.", "He wrote 2^8 and x_1 on it.", "Some 10% were lost [3].",
    'The sign read "a [sic] note".', "The file old_survey_map was lost.", "See http://site4.example/a_b for R&D news.", "The set {a, b} was not closed.", "If a == b, the rule fails.",
    "It was ranked #1 and #3 in C#.", "He multiplied 5 * 4 * 3 by hand.", "The A | B series ended.", "The road (~12 km) is closed.", "- one\n- two", "1. one\n2. two", "> said", "", "it's 5'' long",
]
MARKED = {
    "<b>x</b> y": ["html"], "a&nbsp;b": ["html"], "a <!-- c --> b": ["html"], "years.</td></tr></": ["html"], "gallery.<b": ["html"], "many years.<": ["html"],
    "# Head\n\ntext": ["markdown"], "Head\n=====\n\ntext": ["markdown"], "a **b** c": ["markdown"], "a __b__ c": ["markdown"], "a *b* c": ["markdown"], "[a](http://b.example/c)": ["markdown"], "See [a][2].": ["markdown"], "![x](img/3": ["markdown"], "```\ncode <b>\n```": ["markdown"], "- see `a[i]`": ["markdown"], "| a | b |\n|---|---|\n| c | 8 |": ["markdown"],
    "[[A|b]] c": ["wiki"], "[[A": ["wiki"], "{{cn|date=x": ["wiki"], "== H ==\nt": ["wiki"], "''a'' b": ["wiki"], "'''a''' b": ["wiki"], "{| class=x\n! a !! b\n|-\n| 1 || 2\n|}": ["wiki"], "#REDIRECT [[A]]": ["wiki"], "[http://s.example/x Name] t": ["wiki"],
    "\\emph{a} b": ["latex"], "text~\\citep{re": ["latex"], "where $v = \\sqrt{2gh}$ holds": ["latex"], "\\[ a_i \\]": ["latex"], "\\begin{verbatim}\nreturn a[i]\n\\end{verb": ["latex"], "About 5\\% of it": ["latex"],
    "<i>a</i> and '''b'''": ["html", "wiki"], "\\section{A}\n# B": ["markdown", "latex"],
}


@pytest.mark.parametrize("text", PLAIN)
def test_signs_of_sentences_are_no_markup(text):
    assert m.clean(text)[1] == []


@pytest.mark.parametrize("text", list(MARKED))
def test_kinds(text):
    assert m.clean(text)[1] == MARKED[text]


def test_structure_is_kept():
    t = '<h2>Head</h2><p>One, <a href="x">two</a>.</p><ul><li>a</li><li>b</li></ul><pre><code>x &lt; 1</code></pre>\n\\[ x^2 \\]\n{| \n! a !! b\n|-\n| 1 || 2\n|}'
    assert m.clean(t)[0] == "## Head\n\nOne, two.\n\n- a\n- b\n\n```\nx < 1\n```\n\n$$x^2$$\n\n| a | b |\n| 1 | 2 |"


def test_link_lists_beside_the_text_are_dropped():
    nav = "<nav><ul>" + "".join(f'<li><a href="/{i}">Menu entry number {i}, of many</a></li>' for i in range(9)) + "</ul></nav>"
    body = "<article><p>" + "A long sentence, with commas, that says something about a thing. " * 6 + "</p></article>"
    got = m.clean(f"<body>{nav}{body}</body>")[0]
    assert "Menu" not in got and got.startswith("A long sentence")


def test_table(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "plain  text", "c"), (4, "a <b>x</b>", "c"), (4, "a <b>x</b>", "c"), (5, "y " * 20_000 + "'''z'''", "c")], "occ_id long, context string, clean string")
    rows = m.clean_texts(df, "occ_id", "context").collect()
    assert len(rows) == 6
    got = {r["occ_id"]: (r["clean"], r["kinds"]) for r in rows}
    assert got[1] == (None, []) and got[2] == ("", []) and got[3] == ("plain text", []) and got[4] == ("a x", ["html"]) and got[5][1] == ["wiki"]
    assert sorted(tuple(r) for r in m.markup_kinds(df, "occ_id", "context").collect()) == [(4, "html"), (4, "html"), (5, "wiki")]
    assert m.clean_texts(df.limit(0), "occ_id", "context").count() == 0


def test_headings_underlined_with_dashes_are_found(spark):
    df = spark.createDataFrame([(1, "Head\n-----\n\ntext"), (2, "Head\r\n---\r\ntext"), (3, "Head\r---\rtext"), (4, "one - two\n- three"), (5, None), (6, "a -- b")], "occ_id long, context string")
    cleaned = {(r["occ_id"], k) for r in m.clean_texts(df, "occ_id", "context").collect() for k in r["kinds"]}
    found = [tuple(r) for r in m.markup_kinds(df, "occ_id", "context").collect()]
    assert sorted(found) == [(1, "markdown"), (2, "markdown"), (3, "markdown")] and set(found) == cleaned


def test_spans_of_any_length_and_depth():
    long = "word " * 2_000 + "end"
    assert m.clean(f"a '''{long}''' b") == (f"a {long} b", ["wiki"])
    assert m.clean(f"a **{long}** b") == (f"a {long} b", ["markdown"])
    assert m.clean(f"a __{long}") == (f"a {long}", ["markdown"])
    assert m.clean("x " + "{{a|" * 9 + "z" + "}}" * 9 + " y") == ("x y", ["wiki"])
    assert m.clean("x {{a|" + "{{b|" * 7 + "z") == ("x", ["wiki"])
    assert m.clean("x " + "\\emph{" * 6 + "word" + "}" * 6 + " y") == ("x word y", ["latex"])
    assert m.clean("x \\emph{a \\textbf{b") == ("x a b", ["latex"])
    assert m.clean("**a\n\nb** c") == ("**a\n\nb** c", [])


def test_marks_stay_linear():
    import time

    for sign in ("**a ", "''a ", "{{a|", "\\b{", "__a ", "{", "'''"):
        began = time.perf_counter()
        m.clean(sign * 50_000)
        assert time.perf_counter() - began < 20, sign


def test_containers_of_code_headings_and_items_are_kept():
    body = "<div><p>" + "A long sentence, with commas, that says something about a thing. " * 6 + "</p></div>"
    side = "<div><h3>Use</h3><ul><li>one</li><li>two</li></ul><pre>run x</pre></div>"
    got = m.clean(f"<body>{body}{side}</body>")[0]
    assert got.endswith("### Use\n\n- one\n- two\n\n```\nrun x\n```")
    assert m.clean("<div><pre>only code</pre></div>")[0] == "```\nonly code\n```"
    assert m.clean("<div><h2>Only a head</h2></div>")[0] == "## Only a head"
