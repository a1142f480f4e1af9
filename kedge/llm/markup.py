"""Markup residue out of texts: which kinds a text holds, and clean text that keeps its structure.

A text is read into a tree: block tags open containers and blocks, the text between them is divided
into headings, list items, tables, code, formulas and paragraphs, whether these are written in HTML,
Markdown, wiki markup or TeX. Then the tree is scored: each paragraph passes points for its length
and commas to the container above it and half of them to the next, a container's points are
discounted by its link density, and the best container is kept with those of its siblings that are
not made of links. What is kept is written with one notation: '# ' headings, '- ' list items, code
between fences, table cells between bars, formulas between dollar signs.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedge.session import spread

KINDS = ("html", "markdown", "wiki", "latex")
#: A text without any of these holds no markup of any kind.
TRIGGER = r"[<>&\[\]{}|\\$`#*_=~]|''"
#: Nor does one without a line of dashes, which may underline a heading.
DASHES = r"[\r\n]-{2}"

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)/?>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
SCRIPT = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
PRE = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", re.S | re.I)
CODE_TAG = re.compile(r"<code\b[^<>]*>(.*?)(?:</code\s*>|\Z)", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8}\d{0,2});")
CUT_HTML = re.compile(r"(?:<(?:/?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?|!-{0,2}|/)?|(?<=[^\s<])<)\Z|&(?:#\w{0,6}|nb?s?p?|am?p?|[lr][dts]q?u?o?|qu?o?t?|mdash|ndash|hell?i?p?)\Z")
BARE_CUT = re.compile(r"(?<=\S)<\Z|</?[a-zA-Z][^<>]*\Z|</\Z|<!-{0,2}\Z")

FENCE = re.compile(r"(?m)^[ >]*(```+|~~~+)[^\n`]*\n?(.*?)(?:^[ >]*\1[ ]*$|\Z)", re.S)
TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)(?:\1(?!`)|\Z)")
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\*?\}(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
MATH = re.compile(
    r"\\begin\{(equation|align|displaymath|math|eqnarray|gather)\*?\}(.*?)(?:\\end\{\1\*?\}|\Z)|\\\[(.*?)(?:\\\]|\Z)|\\\((.*?)(?:\\\)|\Z)|\$\$(.+?)(?:\$\$|\Z)"
    r"|(?<![\w$\\])\$(?=[^\s$\d])([^$\n]*[^\s$\\])\$(?!\w)|(?<![\w$\\])\$(?=[^\s$\d])([^$\n]*[\\^_=][^$\n]*)\Z|(?<![\w$\\])\$(?=\d+[ ]*[a-zA-Z\\^_=+*/-])([^$\n]*[\\^_=][^$\n]*)\$",
    re.S,
)
TEX_GROUP = re.compile(r"\\[{}]|(?<![\w:\\./])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|[{}\n]")
COMMAND = re.compile(r"(?<![\w:\\./])\\[a-zA-Z]+|(?<!\\)\\[%&#_{}$](?=[\s\w.,;:)]|\Z)")
CUT_TEX = re.compile(r"(?<=\S)~\\\Z|(?<=[\s.(])\\(?:[a-z]+)?\Z")

WIKI_TABLE = re.compile(r"(?m)^[ :]*\{\|[^\n]*(?:\n|\Z)(.*?)(?:^\|\}|\Z)", re.S)
WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]*)((?:\|[^\[\]|\n]*)*)(?:\]\]|\]?\Z)")
TEMPLATE_OPEN = re.compile(r"(?<![\\\w{])\{\{(?=[^\W\d_#]|#\w|\Z)")
BRACES = re.compile(r"\{\{|\}\}|[{}]")
WIKI_HEAD = re.compile(r"(?m)^(={2,6})(?!=)[ ]*([^=\n][^\n]*?)[ ]*(?:\1[ ]*$|={0,5}\Z)")
QUOTES_OPEN, QUOTES_CLOSE, QUOTES_CUT = re.compile(r"(?<![\w'])'{2,5}(?=[^\s'])"), re.compile(r"(?<=[^\s'])'{2,5}(?!')"), re.compile(r"(?<=[^\s'])\Z")
EXTERNAL = re.compile(r"(?<![\]\w!])\[((?:https?|ftp)://[^\s\]]*)(?:[ ]([^\]\n]*))?(?:\]|\Z)(?!\()")
REDIRECT = re.compile(r"(?im)^#(?:REDIRECT|WEITERLEITUNG|REDIRECTION|REDIRECCIÓN)\b")
MAGIC = re.compile(r"__[A-Z]{3,}__")

MD_HEAD = re.compile(r"(?m)^(#{1,6})[ ]++(\S[^\n]*)$")
SETEXT = re.compile(r"(?m)^(?!\W*$)([^\n|]+)\n(={3,}|-{3,})[ ]*$|^([^\n|.]+[^\n|.:!?])\n(={1,2})\Z")
MD_LINK = re.compile(r"(!?)(?<!\[)\[([^\[\]\n]*)\]\(([^()\s]*(?:[ ]\"[^\"\n]*\")?)(?:\)|\Z)")
REF_LINK = re.compile(r"(?<![\w\]\[])(!?)\[(?=[^\[\]\n]*[^\W\d])([^\[\]\n]*+)\]\[([^\[\]\n]*+)(?:\]|\Z)")
CUT_LINK = re.compile(r"!\[[^\[\]\n]*\]?\Z|(?<![\w\[!])\[(?!sic\b)(?=[^\W\d_][^\[\]\n]{2})[^\[\]\n]*\]?\Z")
STRONG_OPEN = re.compile(r"(?<![\w*])\*{2,3}(?=[^\s*])|(?<![\w_])__(?=[^\s_])")
STRONG_CLOSE = re.compile(r"(?<=[^\s*])\*{2,3}(?!\*)|(?<=[^\s_])__(?![\w_])")
STRONG_CUT = {"*": re.compile(r"(?<=[^\s*])\*{0,2}\Z"), "_": re.compile(r"(?<=[^\s_])_?\Z")}
EMPHASIS = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w_])")
MD_RULE_ROW = re.compile(r"(?m)^[ ]*+\|?+[ ]*+:?-{3,}+:?[ ]*+(?:\|[ ]*+:?-{3,}+:?[ ]*+)*+\|")
MD_ROW = re.compile(r"(?m)^[ ]*+\|[ ][^|\n]++\|(?!\|)(?:[^|\n]++\|)*+(?:[^|\n]*+\Z|[ ]*$)")

LIST_MARK = re.compile(r"[ ]*(?:[-*+•·–]|\d{1,3}[.)]|[*#:;]+)[ ]+(?=\S)")
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li tr td th table thead tbody ul ol dl dt dd blockquote br hr pre caption figure figcaption".split())
CONTAINERS = frozenset("div section article main body nav aside header footer form center".split())
LINK_OPEN, LINK_CLOSE, KEEP = "\ue000", "\ue001", "\ue002"


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which may lie in one another."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out.append(text[at : max(a, at)])
            at = b
    return "".join(out) + text[at:]


def template_spans(t: str) -> list[tuple[int, int]]:
    """Templates, however deep in one another, also cut off at the end. One pass with a stack: a brace that belongs
    to no template keeps those around it."""
    spans: list[tuple[int, int]] = []
    opened: list[int] = []
    starts = {m.start() for m in TEMPLATE_OPEN.finditer(t)}
    at = 0
    while m := BRACES.search(t, at):
        at = m.end()
        if m[0] == "{{" and m.start() in starts:
            opened.append(m.start())
        elif m[0][0] == "{":
            opened.append(-1)
            at = m.start() + 1
        elif m[0] == "}}" and opened and opened[-1] >= 0:
            spans.append((opened.pop(), at))
        elif m[0] == "}" and at == len(t) and opened and opened[-1] >= 0:
            break
        else:
            opened.clear()
            at = m.start() + 1
    while opened and opened[-1] >= 0:
        spans.append((opened.pop(), len(t)))
    return spans


def unwrapped_tex(t: str) -> str:
    """Commands with their braces taken off what they hold, however deep, also cut off at the end; arguments end with their line."""
    spans: list[tuple[int, int]] = []
    opened: list[tuple[int, int] | None] = []
    for m in TEX_GROUP.finditer(t):
        if m[0] == "\n":
            opened.clear()
        elif m[0] == "}":
            if opened and (span := opened.pop()) is not None:
                spans += [span, m.span()]
        elif m[0] == "{":
            opened.append(None)
        elif m[0][-1] == "{" and len(m[0]) > 2:
            opened.append(m.span())
    return without(t, spans + [span for span in opened if span is not None])


def paired(t: str, opener: re.Pattern, closer: re.Pattern, tail: Callable[[str], re.Pattern], alike: bool) -> tuple[str, bool]:
    """Text between marks of one line without them, and whether there was any: each opener goes with the next closer
    (of the same signs if ``alike``); on the last line the end of the text closes too. Marks are found once and
    met by binary search, so spans may be of any length."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in closer.finditer(t):
        ends.setdefault(m[0] if alike else "", []).append(m.span())
    breaks = [i for i, c in enumerate(t) if c == "\n"]
    out, at, tails = [], 0, {}
    for m in opener.finditer(t):
        if m.start() < at:
            continue
        k = bisect(breaks, m.end())
        last = k == len(breaks)
        marks = ends.get(m[0] if alike else "", [])
        j = bisect(marks, (m.end(), len(t)))
        if last and m[0][0] not in tails:
            # the end of the text has at most a few signs, so it is looked for there only
            cut = tail(m[0]).search(t, max(0, len(t) - 3))
            tails[m[0][0]] = cut.span() if cut else (-1, -1)
        if j < len(marks) and (last or marks[j][1] <= breaks[k]):
            inner, after = marks[j]
        elif last and tails[m[0][0]][0] > m.end():
            inner, after = tails[m[0][0]]
        else:
            continue
        out += [t[at : m.start()], t[m.end() : inner]]
        at = after
    return "".join(out) + t[at:], at > 0


@dataclass
class Node:
    tag: str
    text: str = ""
    links: int = 0
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    points: float = 0.0
    size: int = 0
    linked: int = 0

    def add(self, tag: str, text: str = "", links: int = 0) -> Node:
        child = Node(tag, text, links, self)
        self.children.append(child)
        return child

    def measure(self) -> None:
        """Characters of text, and of text in links, of every subtree, from the leaves up."""
        order = [self]
        for n in order:
            order.extend(n.children)
        for n in reversed(order):
            n.size = len(n.text) + sum(c.size for c in n.children)
            n.linked = n.links + sum(c.linked for c in n.children)

    def score(self) -> float:
        return self.points * (1 - self.linked / self.size) if self.size else 0.0


class Reader:
    """One text: ``kinds`` found while reading, and the tree."""

    def __init__(self, text: str) -> None:
        self.kinds: set[str] = set()
        self.kept: list[tuple[str, str]] = []
        self.root = Node("root")
        self._read(text.replace("\r\n", "\n").replace("\r", "\n"))

    def _keep(self, tag: str, text: str) -> str:
        """Code and formulas are set aside, so that nothing inside them is read as markup."""
        self.kept.append((tag, text))
        return f"{KEEP}{len(self.kept) - 1}{KEEP}"

    def _found(self, kind: str, value: str) -> str:
        self.kinds.add(kind)
        return value

    def _read(self, t: str) -> None:
        found, keep = self._found, self._keep
        if "<" in t:
            t = COMMENT.sub(lambda m: found("html", ""), t)
            t = SCRIPT.sub(lambda m: found("html", ""), t)
            t = PRE.sub(lambda m: found("html", "\n" + keep("code", html.unescape(TAG.sub("", m[1]))) + "\n"), t)
            t = CODE_TAG.sub(lambda m: found("html", keep("icode", html.unescape(TAG.sub("", m[1])))), t)
        if "```" in t or "~~~" in t:
            t = FENCE.sub(lambda m: found("markdown", "\n" + keep("code", m[2].strip("\n")) + "\n"), t)
        if "\\" in t:
            t = VERBATIM.sub(lambda m: found("latex", "\n" + keep("code", m[2].strip("\n")) + "\n"), t)
        if "`" in t:
            t = TICKS.sub(lambda m: found("markdown", keep("icode", m[2])), t)
        if "$" in t or "\\" in t:
            t = MATH.sub(lambda m: found("latex", ("\n" + keep("formula", next(g for g in m.groups()[1:] if g is not None).strip()) + "\n") if m[1] or m[3] is not None or m[5] else keep("imath", next((g for g in m.groups() if g is not None), "").strip())), t)
            t = self._tex(t)
        if "{|" in t:
            t = WIKI_TABLE.sub(self._wiki_table, t)
        t = self._inline(t)
        if "<" in t or "&" in t:
            if BARE_CUT.search(t) or CUT_HTML.search(t):
                self.kinds.add("html")
                t = CUT_HTML.sub("", BARE_CUT.sub("", t))
            if ENTITY.search(t):
                self.kinds.add("html")
        self._tree(t)

    def _tex(self, t: str) -> str:
        if COMMAND.search(t) or CUT_TEX.search(t):
            self.kinds.add("latex")
            t = re.sub(r"\\((?:sub)*)section\*?\{([^{}\n]*)(?:\}|\Z)", lambda m: "\n" + KEEP + "h" + "#" * (1 + len(m[1]) // 3) + " " + m[2] + "\n", t)
            t = re.sub(r"~?\\(?:cite[a-z]*|ref|label|pageref|eqref)\*?(?:\[[^\]]*\])?(?:\{[^{}\n]*(?:\}|\Z))?", "", t)
            t = re.sub(r"\\(?:begin|end)\{[^{}\n]*(?:\}|\Z)", "\n", t)
            t = re.sub(r"\\item\b[ ]*", "\n- ", t)
            t = unwrapped_tex(t)
            t = COMMAND.sub(lambda m: m[0][1:] if not m[0][1].isalpha() else "", t)
            t = CUT_TEX.sub("", t)
        return t

    def _wiki_table(self, m: re.Match) -> str:
        self.kinds.add("wiki")
        rows = []
        for row in re.split(r"(?m)^\|-[^\n]*$", m[1]):
            cells = [c.rpartition("|")[2].strip() for line in row.split("\n") if line[:1] in "|!" for c in re.split(r"\|\||!!", line[1:]) if line]
            if cells:
                rows.append("\t".join(cells))
        return "\n" + self._keep("table", "\n".join(rows)) + "\n"

    def _link(self, shown: str) -> str:
        return f"{LINK_OPEN}{shown}{LINK_CLOSE}" if shown else ""

    def _inline(self, t: str) -> str:
        found = self._found

        def wiki_link(m: re.Match) -> str:
            self.kinds.add("wiki")
            target, shown = m[1].strip(), m[2].rpartition("|")[2].strip()
            if re.match(r"(?i)(?:category|kategorie|catégorie|categoría|file|image|datei|fichier|archivo):", target):
                return ""
            return self._link(shown or target)

        if "[" in t or "{{" in t or "''" in t or "==" in t or "__" in t:
            t = REDIRECT.sub(lambda m: found("wiki", ""), t)
            if spans := template_spans(t):
                t = found("wiki", without(t, spans))
            t = WIKI_LINK.sub(wiki_link, t)
            t = EXTERNAL.sub(lambda m: found("wiki", self._link(m[2] or m[1])), t)
            t = SETEXT.sub(lambda m: found("markdown", KEEP + "h" + ("# " if (m[2] or m[4])[0] == "=" else "## ") + (m[1] or m[3])), t)
            t = WIKI_HEAD.sub(lambda m: found("wiki", KEEP + "h" + "#" * (len(m[1]) - 1) + " " + m[2]), t)
            t, held = paired(t, QUOTES_OPEN, QUOTES_CLOSE, lambda _: QUOTES_CUT, alike=False)
            t = found("wiki", t) if held else t
            t = MAGIC.sub(lambda m: found("wiki", ""), t)
            if re.search(r"\n==?\Z", t):
                t = found("wiki", re.sub(r"\n==?\Z", "", t))
        elif "\n--" in t:
            t = SETEXT.sub(lambda m: found("markdown", KEEP + "h" + ("# " if (m[2] or m[4])[0] == "=" else "## ") + (m[1] or m[3])), t)
        if "#" in t and MD_HEAD.search(t):
            self.kinds.add("markdown")
        t = t.replace(KEEP + "h", "")
        if "[" in t:
            t = MD_LINK.sub(lambda m: found("markdown", "" if m[1] else self._link(m[2])), t)
            t = REF_LINK.sub(lambda m: found("markdown", "" if m[1] else self._link(m[2])), t)
            if CUT_LINK.search(t):
                t = found("markdown", CUT_LINK.sub(lambda m: m[0].lstrip("!["), t))
        if "*" in t or "_" in t:
            t, held = paired(t, STRONG_OPEN, STRONG_CLOSE, lambda mark: STRONG_CUT[mark[0]], alike=True)
            t = found("markdown", t) if held else t
            t = EMPHASIS.sub(lambda m: found("markdown", m[1] or m[2]), t)
        if "|" in t:
            if MD_RULE_ROW.search(t) or MD_ROW.search(t):
                self.kinds.add("markdown")
                t = re.sub(r"(?m)(?:^[ ]*\|[^\n]*(?:\n|\Z))+", self._md_table, t)
        return t

    def _md_table(self, m: re.Match) -> str:
        rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in m[0].split("\n") if line.strip()]
        body = ["\t".join(r) for r in rows if not all(re.fullmatch(r":?-*:?", c) for c in r)]
        return "\n" + self._keep("table", "\n".join(body)) + "\n"

    def _tree(self, t: str) -> None:
        at, node = 0, self.root
        buffer: list[str] = []
        tag = "p"
        cells: list[str] | None = None

        def flush() -> None:
            nonlocal buffer, cells
            text = "".join(buffer)
            buffer = []
            if cells is not None:
                cells.append(" ".join(text.split()))
            else:
                self._lines(node, tag, text)

        for m in TAG.finditer(t):
            self.kinds.add("html")
            buffer.append(t[at : m.start()])
            at = m.end()
            close, name = bool(m[1]), m[2].lower()
            if name == "a":
                buffer.append(LINK_CLOSE if close else LINK_OPEN)
                continue
            if name not in BLOCKS and name not in CONTAINERS:
                continue
            if cells is not None and name in ("td", "th"):
                if "".join(buffer).strip():
                    flush()
                continue
            flush()
            if name == "tr":
                if cells:
                    node.add("table", "\t".join(cells).replace(LINK_OPEN, "").replace(LINK_CLOSE, ""))
                cells = None if close else []
            elif name == "table":
                if close and cells:
                    node.add("table", "\t".join(cells))
                cells = None
            elif name in CONTAINERS:
                if not close:
                    node = node.add(name)
                elif node.parent is not None:
                    up: Node | None = node
                    while up is not None and up.tag != name:
                        up = up.parent
                    node = up.parent if up is not None and up.parent is not None else node
            tag = name if not close and name in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "caption") else "p"
        buffer.append(t[at:])
        flush()
        if cells:
            node.add("table", "\t".join(cells))

    def _lines(self, node: Node, tag: str, text: str) -> None:
        """Text between two block tags into leaves."""
        for part in re.split(rf"({KEEP}\d+{KEEP})(?=\n)", text + "\n"):
            whole = re.fullmatch(rf"{KEEP}(\d+){KEEP}", part)
            if whole and self.kept[int(whole[1])][0] in ("code", "formula", "table"):
                kind, body = self.kept[int(whole[1])]
                node.add(kind, body)
                continue
            part = re.sub(rf"{KEEP}(\d+){KEEP}", self._back, part)
            for block in re.split(r"\n[ \t]*\n|\n(?=[ ]*(?:#{1,6} |[-*+•·–] |\d{1,3}[.)] ))", html.unescape(part)):
                lines = block.strip("\n").split("\n")
                head = re.match(r"(#{1,6}) +(\S.*)", lines[0])
                if head:
                    self._leaf(node, "h" + str(len(head[1])), head[2])
                    lines = lines[1:]
                body = "\n".join(lines)
                mark = LIST_MARK.match(body)
                self._leaf(node, "li" if mark else tag, body[mark.end() :] if mark else body)

    def _back(self, m: re.Match) -> str:
        kind, body = self.kept[int(m[1])]
        return f"`{body}`" if kind == "icode" else f"${body}$" if kind in ("imath", "formula") else body

    def _leaf(self, node: Node, tag: str, text: str) -> None:
        links = sum(map(len, re.findall(f"{LINK_OPEN}([^{LINK_OPEN}{LINK_CLOSE}]*)", text)))
        text = text.replace(LINK_OPEN, "").replace(LINK_CLOSE, "")
        text = re.sub(r"[ \t\u00a0]+", " ", text).strip()
        if text:
            node.add(tag, text, links)


#: Leaves that are structure by themselves: a container that holds one is no boilerplate unless it is made of links.
STRUCTURE = frozenset(("code", "formula", "table"))


def score_tree(root: Node) -> None:
    """Every leaf passes points for length, and for commas if it is text, to the container above, and half to the next.

    Short ones (headings, items, formulas) pass a share of a point, so a container made of them has a score too.
    """
    root.measure()
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if c.tag in CONTAINERS:
                todo.append(c)
                continue
            points = min(len(c.text) / 25, 1) + min(len(c.text) / 100, 3)
            if c.tag in ("p", "li", "dd", "blockquote", "table") and len(c.text) >= 25:
                points += c.text.count(",")
            node.points += points
            if node.parent is not None:
                node.parent.points += points / 2


def _holds_structure(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in STRUCTURE:
            return True
        todo.extend(n.children)
    return False


def best_blocks(root: Node) -> list[Node]:
    """The leaves of the best container and of those siblings that aren't made of links, in order of the text.

    A sibling stays if its score is a fifth of the best one's, or if it holds code, a formula or a table.
    """
    every = [root]
    for n in every:
        every.extend(c for c in n.children if c.tag in CONTAINERS)
    top = max(every, key=Node.score)
    family = top.parent.children if top.parent is not None else [top]
    least = 0.2 * top.score()
    kept: list[Node] = []

    for n in family:
        mostly_links = n.linked >= (0.5 if n.tag in CONTAINERS else 0.8) * max(1, n.size)
        if n is top or not mostly_links and (n.tag not in CONTAINERS or n.score() >= least or _holds_structure(n)):
            todo = [n]
            while todo:
                m = todo.pop()
                if m.tag in CONTAINERS or m.tag == "root":
                    todo.extend(reversed(m.children))
                else:
                    kept.append(m)
    return kept


def render(blocks: list[Node]) -> str:
    out: list[str] = []
    last = ""
    for b in blocks:
        if b.tag[0] == "h" and b.tag[1:].isdigit():
            text, sep = "#" * int(b.tag[1:]) + " " + b.text, "\n\n"
        elif b.tag in ("li", "dt", "dd"):
            text, sep = "- " + b.text.replace("\n", " "), "\n" if last in ("li", "dt", "dd") else "\n\n"
        elif b.tag == "code":
            text, sep = f"```\n{b.text}\n```", "\n\n"
        elif b.tag == "formula":
            text, sep = f"$${b.text}$$", "\n\n"
        elif b.tag == "table":
            text, sep = "\n".join("| " + " | ".join(r.split("\t")) + " |" for r in b.text.split("\n")), "\n" if last == "table" else "\n\n"
        else:
            text, sep = b.text, "\n\n"
        out.append((sep if out else "") + text)
        last = b.tag
    return "".join(out)


def clean(text: str) -> tuple[str, list[str]]:
    """(clean text, kinds of markup found)."""
    reader = Reader(text)
    score_tree(reader.root)
    return render(best_blocks(reader.root)), [k for k in KINDS if k in reader.kinds]


def clean_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clean, kinds) of every row. A null text stays null and an empty one empty, without kinds.

    Texts that hold none of the TRIGGER signs have no markup; they pass on the JVM side and are only
    divided into paragraphs and list items like the others when they have line breaks.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None, []) if t is None else clean(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=[key, "clean", "kinds"])

    rows = df.select(key, text)
    marked = F.coalesce(F.col(text).rlike(TRIGGER) | F.col(text).contains("\n") | F.col(text).contains("\r"), F.lit(False))
    plain = rows.filter(~marked).select(key, F.trim(F.regexp_replace(text, "[ \\t\u00a0]+", " ")).alias("clean"), F.array().cast("array<string>").alias("kinds"))
    return spread(rows.filter(marked)).mapInArrow(run, f"{key} {kind}, clean string, kinds array<string>").unionByName(plain)


def markup_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind): one row for each kind of markup of each text, from the same reading as the clean text."""
    held = df.filter(F.col(text).rlike(f"{TRIGGER}|{DASHES}"))
    return clean_texts(held, key, text).select(key, F.explode("kinds").alias("kind"))
