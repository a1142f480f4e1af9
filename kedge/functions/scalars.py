"""Scalar functions as Column expressions: log-space numbers, IRIs, types, names. All are null for null input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces and prefixes of the type vocabularies.
RESOURCE_NS = "http://kb.example/resource/"
TYPE_NAMESPACES = {
    "http://dbpedia.org/ontology/": "DBpedia",
    "http://rdf.freebase.com/ns": "Freebase",
    "http://schema.org/": "Schema",
    "http://sw.opencyc.org/concept/": "OpenCyc",
    "http://www.wikidata.org/entity/": "Wikidata",
    "http://www.ontologydesignpatterns.org/ont/dul/DUL.owl#": "DUL",
}
TYPE_PREFIXES = {"d": "DBpedia", "f": "Freebase", "s": "Schema", "o": "OpenCyc", "w": "Wikidata", "dul": "DUL"}
#: Coefficients of the linear mixture and totals that the results depend on.
MIX_PRIOR, MIX_CONTEXT, MIX_OFFSET = 1234.3989, 0.9968, -0.0275
TOTAL_OCCURRENCES = 69772256
NAME_STOPWORDS = ("the", "a", "an")


def log_zero() -> Column:
    return F.lit(float("-inf"))


def ln(x: Column) -> Column:
    """Natural logarithm with ln(0) = -infinity (the built-in gives null)."""
    return F.when(x == 0, log_zero()).otherwise(F.log(x))


def exp(x: Column) -> Column:
    return F.when(x == log_zero(), F.lit(0.0)).otherwise(F.exp(x))


def ln_sum(a: Column, b: Column) -> Column:
    """ln(exp a + exp b); -infinity is neutral."""
    top = F.greatest(a, b)
    return F.when(top == log_zero(), log_zero()).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def ln_sum_over(values: Column) -> Column:
    """ln of the sum of exponentials of an array, shifted by its maximum; -infinity for an empty one."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.when((F.size(values) == 0) | (top == log_zero()), log_zero()).otherwise(top + F.log(total))


def ln_product(*xs: Column) -> Column:
    """Sum of logarithms; -infinity absorbs."""
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def strip_namespace(uri: Column, namespace: str = RESOURCE_NS) -> Column:
    return F.when(F.startswith(uri, F.lit(namespace)), F.substring(uri, len(namespace) + 1, 2**30)).otherwise(uri)


def wiki_encode(title: Column) -> Column:
    """Blanks to underscores, then percent-escapes but for the characters titles may hold."""
    enc = F.url_encode(F.translate(title, " ", "_"))
    for esc, char in (("%2C", ","), ("%28", "("), ("%29", ")"), ("%3A", ":"), ("%21", "!"), ("%27", "'"), ("%2F", "/"), ("%40", "@")):
        enc = F.replace(enc, F.lit(esc), F.lit(char))
    return enc


def normalise_uri(uri: Column, namespace: str = RESOURCE_NS) -> Column:
    """Without namespace, wiki-encoded unless it already holds percent-escapes."""
    bare = strip_namespace(uri, namespace)
    return F.when(bare.rlike("%[0-9a-fA-F]{2}"), bare).otherwise(wiki_encode(bare))


def full_uri(uri: Column, namespace: str = RESOURCE_NS) -> Column:
    return F.when(is_external(uri), uri).otherwise(F.concat(F.lit(namespace), uri))


def is_external(uri: Column) -> Column:
    return F.startswith(uri, F.lit("http://")) | F.startswith(uri, F.lit("https://"))


def decode(uri: Column) -> Column:
    """Percent-escapes decoded; a text that isn't well escaped stays."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def decode_twice(uri: Column) -> Column:
    return wiki_encode(decode(decode(uri)))


def surface_form_of(uri: Column, lower: bool = False) -> Column:
    """A title as a name: decoded, underscores to blanks, without a bracketed qualifier at its end."""
    name = F.trim(F.regexp_replace(F.translate(decode(uri), "_", " "), " \\([^)]*\\)$", ""))
    return F.lower(name) if lower else name


def keywords_of(uri: Column) -> Column:
    """+"Title" and, for a qualified title, +"Qualifier"; the qualifier 'disambiguation' is none."""
    name = F.translate(decode(uri), "_", " ")
    inner = F.regexp_extract(name, " \\(([^)]*)\\)$", 1)
    title = F.concat(F.lit('+"'), F.regexp_replace(name, " \\([^)]*\\)$", ""), F.lit('"'))
    return F.when(inner.isin("", "disambiguation"), title).otherwise(F.concat(title, F.lit(' +"'), inner, F.lit('"')))


def type_of_uri(uri: Column) -> Column:
    """Type id of a vocabulary's IRI; unknown vocabularies keep the IRI."""
    out = None
    for ns, name in TYPE_NAMESPACES.items():
        rest = F.substring(uri, len(ns) + 1, 2**30)
        cond = F.startswith(uri, F.lit(ns))
        value = F.concat(F.lit(f"{name}:"), rest)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(uri)


def type_of_qname(name: Column) -> Column:
    """Type id of a prefixed name; a known vocabulary name or an unknown prefix stays."""
    prefix = F.lower(F.split_part(name, F.lit(":"), F.lit(1)))
    rest = F.regexp_replace(name, "^[^:]*:", "")
    out = None
    for short, long in TYPE_PREFIXES.items():
        out = F.when(prefix == short, F.concat(F.lit(f"{long}:"), rest)) if out is None else out.when(prefix == short, F.concat(F.lit(f"{long}:"), rest))
    return F.when(~F.contains(name, F.lit(":")), name).otherwise(out.otherwise(name))


def types_of_csv(types: Column) -> Column:
    """Type ids of a comma list; blanks are trimmed, empty entries dropped, null is no types."""
    parts = F.transform(F.split(types, ","), lambda t: F.trim(t))
    return F.coalesce(F.transform(F.filter(parts, lambda t: t != ""), type_of_qname), F.array().cast("array<string>"))


def freebase_domain(path: Column) -> Column:
    """First part of '/domain/type'."""
    return F.split_part(path, F.lit("/"), F.lit(2))


def alternatives(name: Column) -> Column:
    """A name, lower-cased, without a leading article, without a final s, with punctuation as blanks: distinct, in this order."""
    bare = F.regexp_replace(name, "(?i)^(the|an|a) ", "")
    return F.array_distinct(F.array(name, F.lower(name), bare, F.regexp_replace(name, "s$", ""), F.trim(F.regexp_replace(name, "[^\\p{L}\\p{N}]+", " "))))


def nt_escape(text: Column) -> Column:
    """N-Triples escapes: backslash forms for quote, backslash and control characters, \\uXXXX or \\UXXXXXXXX beyond ASCII."""
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def one(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(c == "\\", "\\\\")
        for k, v in list(named.items())[1:]:
            out = out.when(c == k, v)
        long = F.concat(F.lit("\\U"), F.lpad(F.hex(code.cast("long")), 8, "0"))
        short = F.concat(F.lit("\\u"), F.lpad(F.hex(code.cast("long")), 4, "0"))
        return out.when((code >= 32) & (code < 127), c).when(code > 65535, long).otherwise(short)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def category_of(uri: Column) -> Column:
    return F.regexp_replace(uri, "^(http://[^/]*/resource/)?Category:", "")


def edit_score(a: Column, b: Column) -> Column:
    """1 if equal, .85 if equal but for case, else .85 times one less the edit distance by length."""
    near = 0.85 * (1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b)))
    return F.when(a == b, 1.0).when(F.lower(a) == F.lower(b), 0.85).otherwise(near)


def normalise_name(name: Column) -> Column:
    """Punctuation to blanks, lower case, articles out."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*NAME_STOPWORDS)), " ")


def sanitise_query(text: Column) -> Column:
    """Characters that query parsers read as operators become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, '[+\\-&|!(){}\\[\\]^"~*?:\\\\/]', " "), " +", " "))


def accept_in_matrix(token: Column) -> Column:
    """Tokens that may head a column of an agreement matrix: letters only, two or more."""
    return token.rlike("^\\p{L}{2,}$")


def rss_time(text: Column) -> Column:
    """Feed dates in either of two patterns, in UTC; the weekday is dropped first, anything else gives null."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(bare, " GMT$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def strip_html(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<!\\[CDATA\\[|\\]\\]>", ""), "<[^>]*>", "")


def rerank(context: Column, topical: Column, place: Column, person: Column, prior: Column) -> Column:
    return context * topical * place * person * (1 + 10 * prior)


def perplexity(probabilities: Column) -> Column:
    """2 to the entropy of an array of probabilities."""
    return F.pow(F.lit(2.0), F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def is_acronym_of(short: Column, title: Column) -> Column:
    """Whether the letters of ``short`` are, in order, initials of the title's words (greedily)."""
    initials = F.array_join(F.transform(F.split(F.lower(title), "[ _]+"), lambda w: F.substring(w, 1, 1)), "")
    letters = F.filter(F.split(F.lower(short), ""), lambda c: c != "")
    lost = F.lit(None).cast("string")

    def eat(left: Column, c: Column) -> Column:
        at = F.position(c, left)
        return F.when(at > 0, F.substr(left, at + 1)).otherwise(lost)

    rest = F.aggregate(letters, initials, eat)
    return (F.size(letters) > 1) & rest.isNotNull()


def title_of_url(url: Column) -> Column:
    """A page address as title: what follows the last '/wiki/', without anchor and slashes at its end, decoded."""
    path = F.regexp_replace(F.regexp_replace(url, "^.*/wiki/", ""), "#.*$", "")
    return decode(F.regexp_replace(path, "/+$", ""))
