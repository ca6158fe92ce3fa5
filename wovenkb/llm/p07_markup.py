"""Markup residue in text documents.

Method: tag-path ratios. A document is read as nodes, each with its path from the root: the elements of HTML, and
likewise the headings, lists, links, tables, commands and formulas of Markdown, wiki and LaTeX. Text length and
punctuation are aggregated for each path, smoothed over neighbouring nodes and fused to one score. The scores decide
what a document holds: marks that two kinds of markup share (``#`` and ``*`` at the beginning of a line, lines set in by
a blank) belong to the kind whose own paths score higher, and the kinds of all paths that then have a score are
reported. In pages of HTML they also decide what is content: paths under a threshold are left out as boilerplate.
Converters bring what stays to one plain notation that keeps headings, lists, code blocks, tables and formulas; code
blocks and formulas are taken out first and put back unchanged.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("html", "markdown", "wiki", "latex")

# Elements of HTML, the blocks among them, and LaTeX commands that stand without braces.
_TAGS = (
    "html head body title meta link style script noscript div span p br hr a b i u s em strong small big sub sup font center h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre code kbd samp var tt q cite img figure figcaption section article header footer nav aside main form input button select option label textarea iframe ref nowiki syntaxhighlight source math del ins mark abbr details summary"
)
_COMMANDS = (
    "alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega sum prod int frac sqrt cdot times leq geq neq approx infty partial nabla left right ldots dots noindent item maketitle tableofcontents "
    "newpage clearpage bigskip medskip smallskip hline toprule midrule bottomrule centering quad qquad textbackslash LaTeX TeX par indent hfill vfill appendix in to pm"
)
_TAG = re.compile(r"<(/?)(" + "|".join(_TAGS.split()) + r")\b((?:\s[^<>]*|/|\s*)?)>", re.I)
_DECLARATION = re.compile(r"<!--.*?-->|<!doctype[^<>]*>", re.I | re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

_BLOCKS = re.compile(
    r"(?P<fence>^(?P<mark>```+|~~~+)[^\n`]*\n.*?(?:^(?P=mark)[`~]*[ \t\r]*$|\Z))"
    r"|(?P<pre><pre\b[^<>]*>.*?</pre\s*>)"
    r"|(?P<source><(?P<src>syntaxhighlight|source)\b[^<>]*>.*?</(?P=src)\s*>)"
    r"|(?P<code><code\b[^<>]*>.*?</code\s*>)"
    r"|(?P<nowiki><nowiki>.*?</nowiki>)"
    r"|(?P<verbatim>\\begin\{(?P<env>verbatim|lstlisting|minted)\}.*?\\end\{(?P=env)\})",
    re.M | re.S | re.I,
)
_BLOCK_KIND = {"fence": "markdown", "pre": "html", "code": "html", "source": "wiki", "nowiki": "wiki", "verbatim": "latex"}

# Formulas of any length: none goes on over the beginning of another, so that unclosed ones are scanned once.
_INLINE_MATH = r"(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.)+?(?<!\s)\$(?![\d$])"
_MATH = re.compile(r"\$\$(?:[^$\\]|\\.)+?\$\$|\\\[(?:(?!(?<!\\)\\\[).)+?\\\]|\\\((?:(?!(?<!\\)\\\().)+?\\\)|" + _INLINE_MATH + r"|\\begin\{(?P<menv>equation|align|gather|multline|displaymath)\*?\}.*?\\end\{(?P=menv)\*?\}", re.S)
_LATEX = re.compile(r"\\(?:begin|end)\{|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|\\(?:" + "|".join(_COMMANDS.split()) + r")(?![a-zA-Z])|(?<=[\d\w])\\[%&]")
# The marks of Markdown: a character without which the pattern can't match, its name in paths, and the pattern.
_MARKDOWN = tuple((c, name, re.compile(p, re.M)) for c, name, p in (
    ("**", "strong", r"(?<![*\\])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*"),
    ("__", "strong", r"(?<![_\w])__(?=[^\s_])[^_\n]*[^\s_]__(?!\w)"),
    ("~~", "struck", r"~~(?=[^\s~])[^~\n]+~~"),
    ("](", "link", r"!?\[[^\]\[\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),
    ("`", "code", r"(?<!`)`[^`\n]+`(?!`)"),
    ("---", "table", r"^ {0,3}\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*$"),
    (">", "quote", r"^> +\S[^\n]*"),
    ("*", "emphasis", r"(?<![*\w\\])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![*\w])"),
    ("_", "emphasis", r"(?<![_\w\\{}$^])_(?=[^\s_])[^_\n]*[^\s_]_(?!\w)"),
    ("]:", "link", r"^\[[^\]\n]+\]:[ \t]*\S+"),
))
_HASH = re.compile(r"^( {0,3})#{1,6}[ \t]+(\S[^\n]*)", re.M)
_STARS = re.compile(r"^ {0,3}[*+][ \t]+(\S[^\n]*)", re.M)
_UNDERLINE = re.compile(r"\n(={3,}|-{3,})[ \t]*(?=\n|\Z)")
_NO_HEADING = re.compile(r"[ \t]*(?:[-*+>#|=]|\d+[.)])|[ \t]*$")


def _underlined(text: str) -> list[tuple[int, re.Match]]:
    """Headings underlined by = or -: where the line begins, and the match of the underline."""
    out = []
    for m in _UNDERLINE.finditer(text):
        begin = text.rfind("\n", 0, m.start()) + 1
        line = text[begin : m.start()]
        if not _NO_HEADING.match(line) and "|" not in line:
            out.append((begin, m))
    return out


_WIKI = re.compile(
    r"(?P<link>\[\[[^\[\]\n]+\]\])|(?P<template>\{\{[^{}\n]+\}\})|(?P<emphasis>'''?(?=[^\s'])[^\n]*?'''?)|(?P<heading>^={2,6}[^=\n].*?={2,6}[ \t\r]*$)"
    r"|(?P<table>^\{\||^\|\}|^\|-+[ \t]*$)|(?P<switch>__(?:TOC|NOTOC|NOEDITSECTION)__)|(?P<address>\[https?://\S+ [^\]\n]+\])",
    re.M,
)
#: Paths that structure lines, as opposed to marks inside a line.
_STRUCTURE = frozenset(("wiki/heading", "wiki/table", "markdown/heading", "markdown/table", "markdown/quote", "markdown/block"))

#: A node is (where it begins, its path, its text).
Node = tuple[int, str, str]


def mark_nodes(text: str) -> tuple[list[Node], list[Node]]:
    """The marked-up nodes of a text (with normal line ends) in their order: those whose kind is certain, and those
    whose marks Markdown and wiki share. What stands inside a code block gives no node, the block itself one."""
    sure: list[Node] = []

    def seen(pattern: re.Pattern, path: str, fill: str = " "):
        def one(m: re.Match) -> str:
            sure.append((m.start(), path, m[0]))
            return fill * len(m[0])

        return pattern.sub(one, text)

    def block(m: re.Match) -> str:
        kind = _BLOCK_KIND[m.lastgroup if m.lastgroup in _BLOCK_KIND else next(k for k in _BLOCK_KIND if m[k] is not None)]
        sure.append((m.start(), f"{kind}/block", m[0]))
        return "\n" * len(m[0])

    if "```" in text or "~~~" in text or "<" in text or "\\begin" in text:
        text = _BLOCKS.sub(block, text)
    if "<" in text:
        stack: list[str] = []
        text = seen(_DECLARATION, "html/declaration")
        last = None
        for m in _TAG.finditer(text):  # a tag's node is the text up to the next tag
            if last is not None:
                sure.append((last.start(), "html/" + "/".join(stack), text[last.end() : m.start()]))
            _walk(stack, m)
            last = m
        if last is not None:
            sure.append((last.start(), "html/" + "/".join(stack), text[last.end() :]))
            text = _TAG.sub(lambda m: " " * len(m[0]), text)
    if "&" in text:
        text = seen(_ENTITY, "html/entity")
    if "$" in text or "\\" in text:
        held = text
        text = seen(_MATH, "latex/formula")
        for m in _LATEX.finditer(held):
            sure.append((m.start(), "latex/" + m[0].strip("\\{"), m[0]))
    for m in _WIKI.finditer(text) if any(c in text for c in "'[{=_") else ():
        sure.append((m.start(), f"wiki/{m.lastgroup}", m[0]))
    for c, name, p in _MARKDOWN:
        if c in text:
            sure += [(m.start(), f"markdown/{name}", m[0]) for m in p.finditer(text)]
    sure += [(begin, "markdown/heading", text[begin : m.start()]) for begin, m in _underlined(text)]
    shared: list[Node] = []
    if "#" in text:
        hashes = list(_HASH.finditer(text))
        for i, m in enumerate(hashes):
            near = (i > 0 and hashes[i - 1].end() + 1 == m.start()) or (i + 1 < len(hashes) and hashes[i + 1].start() == m.end() + 1)
            shared.append((m.start(), "set in" if m[1] else "run" if near else "line", m[2]))
    if "*" in text or "+" in text:
        shared += [(m.start(), "star", m[1]) for m in _STARS.finditer(text)]
    return sorted(sure), shared


def kind_scores(sure: list[Node]) -> dict[str, tuple[float, float]]:
    """(score of all its paths, score of those that structure lines) of each kind of markup."""
    total: dict[str, tuple[float, float]] = {}
    for path, score in path_scores([(path, text or " ", 0) for _, path, text in sure], links=False).items():
        a, b = total.get(kind := path.partition("/")[0], (0.0, 0.0))
        total[kind] = (a + score, b + score * (path in _STRUCTURE))
    return total


def analyse(text: str) -> tuple[list[str], str]:
    """The kinds of markup in a text, in the order of KINDS, and whether shared marks are "wiki" or "markdown".

    A line with ``#`` is a heading of Markdown unless wiki structures the text; one among others, or set in, is an
    item (or code) of wiki if wiki has the higher score. Stars are items of the kind that is there; in plain text and beside
    HTML alone they count as Markdown.
    """
    if not any(c in text for c in _ANY):
        return [], "markdown"
    sure, shared = mark_nodes(text)
    scores = kind_scores(sure)
    wiki, own = scores.get("wiki", (0.0, 0.0)), scores.get("markdown", (0.0, 0.0))
    for _, shape, words in shared:
        if (shape == "line" and not wiki[1] > own[1]) or (shape in ("run", "set in") and not wiki[0] > own[0]) or (shape == "star" and "wiki" not in scores and "latex" not in scores):
            a, b = scores.get("markdown", (0.0, 0.0))
            scores["markdown"] = (a + len(words), b + len(words))
    owner = "wiki" if wiki[0] > scores.get("markdown", (0.0, 0.0))[0] else "markdown"
    return [k for k in KINDS if k in scores and scores[k][0] > 0], owner


#: A text without any of these has no markup.
_ANY = ("<", "&", "$", "\\", "#", "*", "_", "~", "[", "`", "---", "===", ">", "{", "''", "==", "+", "|")


def kinds(text: str | None) -> list[str]:
    """The kinds of markup that a text holds, in the order of KINDS."""
    return analyse(text.replace("\r\n", "\n").replace("\r", "\n"))[0] if text else []


# Conversion


class _Kept:
    """Code blocks and formulas that are put back unchanged."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, text: str) -> str:
        self.parts.append(self.back(text))  # so no part holds another
        return f"\ue000{len(self.parts) - 1}\ue001"

    def back(self, text: str) -> str:
        if "\ue000" not in text:
            return text
        return re.sub("\ue000(\\d+)\ue001", lambda m: self.parts[int(m[1])] if int(m[1]) < len(self.parts) else m[0], text)


def _fenced(body: str, info: str = "") -> str:
    return f"\n```{info}\n" + body.strip("\n") + "\n```\n"


def _take_blocks(text: str, kept: _Kept) -> str:
    def out(m: re.Match) -> str:
        whole = m[0]
        if m["fence"]:
            lines = whole.split("\n")
            last = lines[-1].strip()
            return kept.put(_fenced("\n".join(lines[1:-1] if last.startswith(m["mark"]) else lines[1:]), lines[0].strip().strip("`~").strip()))
        if m["nowiki"]:
            return kept.put(whole[8:-9])
        if m["verbatim"]:
            return kept.put(_fenced(re.sub(r"^\\begin\{\w+\}(?:\[[^\]]*\])?|\\end\{\w+\}$", "", whole)))
        body = html.unescape(re.sub(r"^<[^<>]*>|</[^<>]*>$", "", whole))
        body = re.sub(r"^\s*<code\b[^<>]*>|</code\s*>\s*$", "", body, flags=re.I)
        return kept.put(_fenced(body) if m["pre"] or m["source"] or "\n" in body else body)

    return _BLOCKS.sub(out, text)


_SKIPPED = re.compile(r"<(script|style|noscript|head)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
_BLOCK_TAGS = frozenset("p div section article header footer nav aside main ul ol dl table blockquote figure form h1 h2 h3 h4 h5 h6 center details summary figcaption tr caption".split())
_VOID = frozenset("br hr img input meta link".split())


def _walk(stack: list[str], m: re.Match) -> None:
    """Take one tag into the stack of open elements; elements that end where the next of their kind begins are closed."""
    tag = m[2].lower()
    if m[1]:
        if tag in stack:
            del stack[len(stack) - 1 - stack[::-1].index(tag) :]
    elif tag not in _VOID and not m[3].endswith("/"):
        if tag in ("li", "tr", "td", "th", "p") and tag in stack[-2:]:
            del stack[len(stack) - 1 - stack[::-1].index(tag) :]
        stack.append(tag)


def path_scores(nodes: list[tuple[str, str, int]], links: bool = True) -> dict[str, float]:
    """Fused score of each path from (path, text, block) nodes: text length and punctuation a node, smoothed over the
    neighbouring nodes of the same block, and with ``links`` weighed by the share that stands outside links."""
    n = len(nodes)
    length = [float(max(1, len(t.strip()))) for _, t, _ in nodes]
    marks = [float(sum(map(t.count, ",.;:!?，。；：！？、"))) for _, t, _ in nodes]

    def smooth(x: list[float]) -> list[float]:
        near = [[(x[j], w) for j, w in ((i - 1, 1), (i, 2), (i + 1, 1)) if 0 <= j < n and nodes[j][2] == nodes[i][2]] for i in range(n)]
        return [sum(v * w for v, w in own) / sum(w for _, w in own) for own in near]

    total: dict[str, list[float]] = {}
    for (path, _, _), a, b, own in zip(nodes, smooth(length), smooth(marks), length):
        x = total.setdefault(path, [0.0, 0.0, 0.0, 0.0, 0.0])
        x[0] += a
        x[1] += b
        x[2] += 1
        x[3] += own * (links and "a" in path.split("/"))
        x[4] += own
    return {p: (x[0] / x[2]) * (1 + x[1] / x[2]) * (1 - x[3] / x[4]) for p, x in total.items()}


#: A path is content with this share of the best path's score; headings, cells, items and quotations are short by nature
#: and are content unless all their text stands in links.
CONTENT = 0.05
_SHORT = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote figcaption title p".split())


def content_paths(nodes: list[tuple[str, str, int]]) -> set[str]:
    """The paths that are content, by their scores."""
    scores = path_scores(nodes)
    least = CONTENT * max(scores.values(), default=0.0)
    return {p for p, s in scores.items() if s >= least or (s > 0 and _SHORT & set(p.split("/")) and "nav" not in p.split("/")) or ("a" in p.split("/") and "p" in p.split("/"))}


def _from_html(text: str, kept: _Kept) -> str:
    text = _SKIPPED.sub("\n", _DECLARATION.sub("", text))
    pieces: list[tuple[str, str | None, str, int]] = []  # (path, tag or None for text, text, block)
    stack: list[str] = []
    at = block = 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            pieces.append(("/".join(stack), None, text[at : m.start()], block))
        at = m.end()
        tag = m[2].lower()
        block += tag in _BLOCK_TAGS or tag in ("li", "td", "th")
        pieces.append(("/".join(stack), ("/" if m[1] else "") + tag, m[3], block))
        _walk(stack, m)
    if at < len(text):
        pieces.append(("/".join(stack), None, text[at:], block))
    content = content_paths([(p, t, b) for p, tag, t, b in pieces if tag is None and t.strip()])
    out: list[str] = []
    lists: list[list] = []
    row: list[str] | None = None
    for path, tag, t, _ in pieces:
        if tag is None:
            if path in content or not t.strip():
                out.append(t)
            continue
        name = tag.lstrip("/")
        if tag in ("ul", "ol"):
            lists.append([tag, 0])
        elif tag in ("/ul", "/ol") and lists:
            lists.pop()
        if tag == "li":
            if lists:
                lists[-1][1] += 1
            out.append("\n" + "  " * (len(lists) - 1) + (f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "))
        elif re.fullmatch("h[1-6]", tag):
            out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "tr":
            row = []
            out.append("\n")
        elif tag in ("td", "th"):
            out.append(" | " if row else "")
            row = [*(row or []), "x"]
        elif tag in ("sub", "sup"):
            out.append("_" if tag == "sub" else "^")
        elif name in ("br",):
            out.append("\n")
        elif name == "hr":
            out.append("\n\n")
        elif name in ("tr", "ul", "ol"):
            out.append("\n")
        elif name in _BLOCK_TAGS:
            out.append("\n\n")
    plain = re.sub(r"(?m)^[ \t]*(?:-|\d+\.)[ \t]*\n(?=[ \t]*(?:-|\d+\.|\n|\Z))", "", "".join(out))  # items whose text was left out
    return html.unescape(plain).replace("\xa0", " ")


_LATEX_DROP = re.compile(r"\\(?:documentclass|usepackage|bibliographystyle|bibliography|label|vspace|hspace|pagestyle|setlength|newcommand)\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})+|\\(?:noindent|maketitle|tableofcontents|newpage|clearpage|centering|hline|toprule|midrule|bottomrule|bigskip|medskip|smallskip|hfill|vfill|indent|par)(?![a-zA-Z])\s?")
_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


_BRACE = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|\\.|[{}]", re.S)


def _unbraced(text: str) -> str:
    """Without commands around braces, to any depth: their text stays. One pass; braces that don't close stay as they are."""
    open_: list[re.Match] = []
    gone: list[tuple[int, int]] = []
    for m in _BRACE.finditer(text):
        if m[0] == "}":
            if open_ and len((begin := open_.pop())[0]) > 1:
                gone += [begin.span(), m.span()]
        elif m[0].endswith("{") and m[0] != "\\{":
            open_.append(m)
    out, last = [], 0
    for a, b in sorted(gone):
        out.append(text[last:a])
        last = b
    return "".join(out) + text[last:]


def _from_latex(text: str, kept: _Kept) -> str:
    text = re.sub(r"(?m)(?<!\\)(?<![\d\w])%[^\n]*\n?", "", text) if "\\" in text else text
    text = _LATEX_DROP.sub("", text)
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}\n]*)\}", lambda m: "\n" + "#" * _HEADS[m[1]] + f" {m[2]}\n", text)

    def table(m: re.Match) -> str:
        rows = re.split(r"\\\\", m[2])
        return "\n" + "\n".join(" | ".join(c.strip() for c in re.split(r"(?<!\\)&", r)) for r in rows if r.strip()) + "\n"

    text = re.sub(r"\\begin\{(tabular[x*]?)\}(?:\{[^{}]*\})*(.*?)\\end\{\1\}", table, text, flags=re.S)
    text = re.sub(r"[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "- " + (f"{m[1]}: " if m[1] else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*", "", text)
    text = re.sub(r"~?\\(?:cite|citep|citet|ref|eqref|pageref)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}", "", text)
    text = re.sub(r"\\footnote\{([^{}\n]*)\}", r" (\1)", text)
    text = re.sub(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}", r"\1", text)
    text = _unbraced(text)
    text = re.sub(r"\\([%&$#_{}])", r"\1", text)
    return re.sub(r"(?<=\S)~(?=\S)", " ", text) if "\\" in text else text


def _set_in(text: str, kept: _Kept) -> str:
    """Lines set in by a blank are code in wiki text; a run of them becomes a block."""
    return re.sub(r"(?m)(?:^ [^\n]*\S[^\n]*(?:\n|\Z))+", lambda m: kept.put(_fenced(re.sub(r"(?m)^ ", "", m[0]))) + "\n", text)


def _from_wiki(text: str, lists: bool) -> str:
    """Plain notation of wiki markup; ``lists``: lines that begin with # are numbered items."""
    text = re.sub(r"\[\[(?:Category|File|Image|分类|文件):[^\[\]\n]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"\{\{formula\|([^{}\n]*)\}\}", lambda m: " ".join(m[1].split("|")), text)
    text = re.sub(r"\{\{[^{}\n]*\}\}", "", text)
    text = re.sub(r"'''''|'''|''", "", text)

    def table(m: re.Match) -> str:
        rows, now = [], []
        for line in m[1].split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append(now)
                now = []
            elif line.startswith("|+"):
                rows.append([line[2:].strip()])
            elif line[:1] in "|!" and line:
                now += [re.sub(r"^[^|\[\]]*=[^|]*\|", "", c).strip() for c in re.split(r"\|\||!!", line[1:])]
        rows.append(now)
        return "\n" + "\n".join(" | ".join(r) for r in rows if r) + "\n"

    text = re.sub(r"(?ms)^\{\|[^\n]*\n(.*?)^\|\}", table, text)
    text = re.sub(r"__(?:TOC|NOTOC|NOEDITSECTION)__", "", text)
    out: list[str] = []
    numbers: list[int] = []
    for line in text.split("\n"):
        m = re.match(r"([*#]+)[ \t]+" if lists else r"(\*+)[ \t]+", line)
        if m:
            numbers = (numbers + [0] * len(m[1]))[: len(m[1])]
            numbers[-1] += 1
            line = "  " * (len(m[1]) - 1) + (f"{numbers[-1]}. " if m[1][-1] == "#" else "- ") + line[m.end() :]
        else:
            numbers = []
        out.append(line)
    return re.sub(r"(?m)^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], "\n".join(out))


def _from_markdown(text: str) -> str:
    for begin, m in reversed(_underlined(text)):
        text = text[:begin] + ("# " if m[1][0] == "=" else "## ") + text[begin : m.start()].strip() + text[m.end() :]
    text = re.sub(r"!?\[([^\]\n]+)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"(?<![*\\])\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*", r"\1", text)
    text = re.sub(r"(?<![_\w])__(?=[^\s_])([^_\n]*[^\s_])__(?!\w)", r"\1", text)
    text = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", text)
    text = re.sub(r"(?<![*\w\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![*\w])", r"\1", text)
    text = re.sub(r"(?<![_\w\\{}$^])_(?=[^\s_])([^_\n]*[^\s_])_(?!\w)", r"\1", text)
    text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", text)
    text = re.sub(r"(?m)^ {0,3}\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*\n?", "", text)
    text = re.sub(r"(?m)^[ \t]*\|([^\n]*\|[^\n]*)$", lambda m: " | ".join(c.strip() for c in m[1].strip().strip("|").split("|")), text)
    text = re.sub(r"(?m)^(?:> ?)+", "", text)
    return re.sub(r"(?m)^( {0,3})[*+][ \t]+(?=\S)", r"\1- ", text)


def clean(text: str | None) -> str | None:
    """Plain text of a document: headings as #, lists as - or numbers, table cells with |, code in fences, formulas as they are."""
    if not text:
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found, owner = analyse(text)
    if not found:
        return text
    kept = _Kept()
    text = _take_blocks(text, kept)
    if "latex" in found or "markdown" in found:
        text = _MATH.sub(lambda m: kept.put(m[0]), text)
    if owner == "wiki":
        text = _set_in(text, kept)
    if "html" in found:
        text = _from_html(text, kept)
    if "latex" in found:
        text = _from_latex(text, kept)
    if "wiki" in found:
        text = _from_wiki(text, owner == "wiki")
    if "markdown" in found:
        text = _from_markdown(text)
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", kept.back(text))
    return text.strip("\n")


def clean_markup(docs: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, markup array<string>, clean_text) for every row, in one pass without a shuffle.

    Null content gives an empty list and null text, empty content an empty text. Text without markup is kept
    but for its line ends; repeated rows and null ids are kept; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(content_col).cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({id_col: df["_id"], "markup": df["_text"].map(kinds), "clean_text": df["_text"].map(clean)})

    return rows.mapInPandas(run, f"`{id_col}` {id_type}, markup array<string>, clean_text string")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_found over kb_documents."""
    return clean_markup(common.table(spark, sf_dir, "kb_documents")).select(F.col("id").alias("document_id"), F.explode("markup").alias("markup")).distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned texts of kb_documents."""
    return clean_markup(common.table(spark, sf_dir, "kb_documents"))


QUERIES = {"p7_found": p7_found, "p7_clean": p7_clean}
SQL: dict[str, str] = {}
