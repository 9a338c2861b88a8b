"""Problem 3: markup residue in text documents.

Labelling is a minimum cut. The nodes are the candidates of a text: everything that is written
like markup, look-alikes included (prices, comparisons, paths, bracketed numbers, names in angle
brackets). A classifier's cost of calling a candidate content or markup is the capacity to the one
or the other terminal. It sees the sign and what stands inside and around it, not which of the
patterns found it, and not its neighbours: these speak through the smoothness edges. Edges join
candidates that are next to each other on a line or on adjacent lines (adjacency), those that open
and close one element, and an element's tag with the one it stands in (DOM proximity), so an
uncertain sign follows its sure partner: an unknown name in angle brackets is content by itself and
markup where it is closed. What the maximal flow leaves on the source's side is markup; nothing else
decides. The classifier is trained on texts made here: plain lines of a bounded sample of the
corpus (about ``SAMPLE`` texts) with constructs and look-alikes set into them, whose labels are known.

``clean`` then renders the text: tags, comments, templates and emphasis go; headings become
``# …``, list items ``- …``, code stays fenced, formulas stay as they are, links keep their words.

A candidate inside a fenced code block is content. Defined results: null, empty and blank texts
have no construct and clean to themselves; both kinds of line end are read, ``\\n`` is written;
repeated rows count once. No text is shuffled: repeats are dropped from the results.
"""

from __future__ import annotations

import html
import html.entities
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table

SAMPLE = 400
DIMENSIONS = 1 << 14

# The element names of HTML.
TAGS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data dd del details dfn div dl dt em embed figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe "
    "img input ins kbd label legend li link main map mark meta nav noscript object ol option p param pre q rp rt ruby s samp script "
    "section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr "
    "tt u ul var video wbr".split()
)

# (family, form, pattern): what a candidate looks like; earlier ones take their characters first.
FORMS: tuple[tuple[str, str, re.Pattern[str]], ...] = tuple(
    (family, form, re.compile(pattern, re.M))
    for family, form, pattern in (
        ("html", "comment", r"<!--[\s\S]*?(?:-->|\Z)"),
        ("html", "declaration", r"<[?!][a-zA-Z][^<>]*>"),
        ("html", "style", r"<(?:style|script)\b[^<>]*>[\s\S]*?</(?:style|script)\s*>"),
        ("html", "tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"),
        ("html", "cut", r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[a-z-]+=(?:\"[^\"<>]*\"?|[^\s<>]*))*\s*(?=\Z)"),
        ("html", "entity", r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"),
        ("html", "lone", r"<(?=[\s\d])|(?<=[ \t])->|(?<=[\d \t])>(?=\s)"),
        ("latex", "display", r"\$\$[^$]+?\$\$|\\\[(?:[^\\]|\\(?!\]))+\\\]|\\\((?:[^\\\n]|\\(?!\)))+\\\)"),
        ("latex", "environment", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"),
        ("latex", "inline", r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\d$])"),
        ("latex", "command", r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{|(?=[\s\\]|\Z))"),
        ("latex", "accent", r"(?<![:\\])\\[\"'`^~=.](?:\{|[A-Za-z])|(?<=[A-Za-z])\\[\"'`^~](?:\{)"),
        ("latex", "escape", r"(?<![\w:\\])\\[&%$#_{}]|\\\\(?=\s*(?:\n|\Z))"),
        ("latex", "lone", r"[A-Za-z]:\\[\w\\]+|\$(?=\d)"),
        ("markdown", "image", r"!\[[^\]\n]*\]\([^)\n]*\)?"),
        ("markdown", "definition", r"^ {0,3}\[\^[^\]\n]+\]:"),
        ("markdown", "note", r"\[\^[^\]\s]+\]"),
        ("wiki", "link", r"\[\[[^\[\]\n]+\]\]"),
        ("wiki", "template", r"\{\{[^{}]*\}\}"),
        ("wiki", "table", r"^\{\|.*$|^\|\}\s*$|^\|-+.*$|^!.*!!.*$|^\|[^|\n]*\|\|.*$|^\|\+.*$"),
        ("wiki", "heading", r"^(={2,6})[ \t]*[^=\s](?:[^\n]*?[^=\s])?[ \t]*\1[ \t]*$"),
        ("wiki", "emphasis", r"(?<!')('{2,3}|'{5})(?=[^'\s])[^'\n]+(?:'[^'\n]+)*?\1(?!')"),
        ("markdown", "link", r"\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),
        ("markdown", "lone", r"\[\d+\]|\[[a-z]+\]|#\d+|(?<=\w)_(?=\w)|(?<=\d )\*(?= \d)"),
        ("markdown", "setext", r"^(?=\S)[^\n|<>=#]+\n(?:={3,}|-{3,})[ \t]*$"),
        ("markdown", "heading", r"^ {0,3}#{1,6}[ \t]+\S.*$"),
        ("markdown", "rule", r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$"),
        ("markdown", "row", r"^[ \t]*\|(?:[^|\n]*\|)+[ \t]*$"),
        ("markdown", "quote", r"^ {0,3}>+(?: ?\S.*)?$"),
        ("markdown", "item", r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+(?=\S)"),
        ("markdown", "strong", r"(?<![\w*])\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?![\w_])"),
        ("markdown", "emphasis", r"(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])"),
        ("markdown", "struck", r"~~(?=\S)[^~\n]+~~"),
        ("markdown", "code", r"(?<!`)`(?=[^`\n])[^`\n]+`(?!`)"),
    )
)
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*$", re.M)
# forms whose inside may hold further candidates: only their outer signs are taken
OPEN_INSIDE = frozenset({"quote", "heading", "row", "setext", "table", "emphasis", "strong"})


@dataclass
class Candidate:
    family: str
    form: str
    start: int
    end: int
    line: int
    features: tuple[int, ...] = ()
    partner: int = -1
    parent: int = -1


def normal_ends(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def fences(text: str) -> list[tuple[int, int]]:
    """Fenced code blocks, their fences included; an unclosed one ends with the text."""
    out, opened, sign = [], -1, ""
    for m in FENCE.finditer(text):
        if opened < 0:
            opened, sign = m.start(), m.group(1)
        elif m.group(1)[0] == sign[0] and len(m.group(1)) >= len(sign) and m.group().strip() == m.group(1):
            out.append((opened, m.end()))
            opened = -1
    if opened >= 0:
        out.append((opened, len(text)))
    return out


def candidates(text: str) -> list[Candidate]:
    taken = bytearray(len(text))
    code = fences(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    found = [Candidate("markdown", "fence", a, b, bisect_right(breaks, a)) for a, b in code]
    for a, b in code:
        taken[a:b] = b"\1" * (b - a)
    for family, form, pattern, needed in NEEDED:
        if not any(sign in text for sign in needed):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if a == b or taken[a] or (form not in OPEN_INSIDE and taken.find(1, a, b) >= 0) or (form in ("row", "quote", "setext") and any(x <= a < y for x, y in code)):
                continue
            found.append(Candidate(family, form, a, b, bisect_right(breaks, a)))
            if form not in OPEN_INSIDE:
                taken[a:b] = b"\1" * (b - a)
            else:
                taken[a] = 1
    found.sort(key=lambda c: (c.start, -c.end))
    _pair(text, found)
    for c in found:
        c.features = _features(text, c)
    return found


# a text without any of these signs has no candidate of the form
SIGNS = {
    "comment": "<!--", "declaration": "<", "style": "<", "tag": "<", "cut": "<", "entity": "&", "display": "$ \\", "environment": "\\", "inline": "$", "command": "\\", "accent": "\\", "escape": "\\",
    "image": "![", "definition": "[^", "note": "[^", "link": "[", "template": "{{", "table": "| !!", "heading": "# =", "emphasis": "'' * _", "setext": "=== ---", "rule": "- * _", "row": "|", "quote": ">",
    "item": "- * + . )", "strong": "** __", "struck": "~~", "code": "`",
}
NEEDED = tuple((family, form, pattern, SIGNS[form].split() if form in SIGNS else [""]) for family, form, pattern in FORMS)


def _tag_name(text: str, c: Candidate) -> str:
    m = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", text[c.start : c.start + 30])
    return m.group(1).lower() if m else ""


def _pair(text: str, found: list[Candidate]) -> None:
    """Opening and closing tags, and environments, point to each other; tags and environments to what they stand in."""
    stacks: dict[str, list[int]] = {}
    inside: list[int] = []
    for i, c in enumerate(found):
        if c.form == "tag":
            name, closing = _tag_name(text, c), text[c.start + 1] == "/"
        elif c.form == "environment":
            name, closing = text[text.index("{", c.start) : c.end], text.startswith("\\end", c.start)
        else:
            continue
        if closing and stacks.get(name):
            j = stacks[name].pop()
            c.partner, found[j].partner = j, i
            if inside and inside[-1] == j:
                inside.pop()
        elif not closing:
            c.parent = inside[-1] if inside else -1
            stacks.setdefault(name, []).append(i)
            inside.append(i)


MATH = re.compile(r"[\\^_={}+<>]|^[A-Za-z0-9]{1,2}$")
ONE_WORD = re.compile(r"[A-Za-z]{3,}")
COMMAND_NAME = re.compile(r"\\[A-Za-z]+")


def _kind(c: str) -> str:
    return "w" if c.isalpha() else "9" if c.isdigit() else "s" if c.isspace() or not c else c


def _length(n: int) -> int:
    return n if n < 4 else 4 if n < 12 else 5


def _features(text: str, c: Candidate) -> tuple[int, ...]:
    """Hashed features: the sign a candidate begins with, its shape, and the characters around it."""
    inner, before, after = text[c.start : c.end], _kind(text[c.start - 1 : c.start]), _kind(text[c.end : c.end + 1])
    bare = inner.lstrip()
    sign, second, last = bare[:1], _kind(bare[1:2]), _kind(inner.rstrip()[-1:])
    sign = "9" if sign.isdigit() else "w" if sign.isalpha() else sign
    run = len(bare) - len(bare.lstrip(bare[:1]))
    starts = before == "\n" or c.start == 0 or text[c.start - 1] == "\n"
    shape = [f"second={second}", f"last={last}", f"run={min(run, 4)}", f"before={before}", f"after={after}", f"starts={starts}", f"length={_length(len(inner))}", f"second={second}|last={last}", f"before={before}|after={after}|last={last}"]
    if sign == "<":
        name = _tag_name(text, c)
        known = "none" if not name else "known" if name in TAGS else "unknown"
        shape += [f"name={known}", f"name={known}|close={second == '/'}", f"name={known}|attributes={'=' in inner}", f"name={known}|ends={inner[-1:] == '>'}"]
    elif sign == "&":
        known = "number" if inner[1:2] == "#" else "known" if inner[1:] in html.entities.html5 else "unknown"
        shape.append(f"name={known}")
    elif sign == "$":
        body = inner.strip("$")
        words = ONE_WORD.findall(COMMAND_NAME.sub("", body))
        shape += [f"math={bool(MATH.search(body))}", f"words={min(3, len(words))}", f"math={bool(MATH.search(body))}|words={min(3, len(words))}", f"alone={len(inner) == 1}"]
    elif sign == "[":
        shape += [f"target={'](' in inner}", f"digits={inner[1:-1].isdigit()}|target={'](' in inner}"]
    elif sign == "|" or c.form in ("row", "table"):
        shape.append(f"cells={min(4, inner.count('|'))}")
    return _hashes(tuple([f"sign={sign}", *(f"{sign}.{x}" for x in shape)]))


@lru_cache(maxsize=200_000)
def _hashes(names: tuple[str, ...]) -> tuple[int, ...]:
    import xxhash

    return tuple(sorted({xxhash.xxh32_intdigest(n) & (DIMENSIONS - 1) for n in names}))


def min_cut(costs: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Whether each node stays with the source; costs > 0 tie it to the source, < 0 to the sink.

    Augmenting paths by breadth-first search over the residual graph (shortest first), level by level.
    """
    n = len(costs)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs.tolist()):
        link(source, i, c, 0.0) if c > 0 else link(i, sink, -c, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    small = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > small and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([x >= 0 for x in level[:n]], bool)
        at = [0] * (n + 2)
        while True:
            path: list[int] = []
            a = source
            while a != sink:
                while at[a] < len(head[a]):
                    e = head[a][at[a]]
                    if room[e] > small and level[to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] == len(head[a]):
                    if a == source:
                        break
                    level[a] = -1
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != sink:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow


ADJACENT, SAME_BLOCK, PARTNER, PARENT = 0.3, 0.6, 4.0, 0.3


def label(found: list[Candidate], weights: np.ndarray, edges: bool = True) -> np.ndarray:
    """Whether each candidate is markup. ``edges``: whether neighbours speak, for comparison."""
    if not found:
        return np.zeros(0, bool)
    costs = [max(-12.0, min(12.0, _cost(c.features, weights))) for c in found]
    links = []
    for i, c in enumerate(found):
        if c.partner > i:
            links.append((i, c.partner, PARTNER))
        if c.parent >= 0:
            links.append((c.parent, i, PARENT))
        if i:
            p = found[i - 1]
            if p.family == c.family and c.line - p.line <= 1:
                links.append((i - 1, i, SAME_BLOCK if p.form == c.form else ADJACENT))
    # where no edge joins two candidates that their own costs would part, the costs' signs are the minimum cut
    if not edges or all((costs[a] > 0) == (costs[b] > 0) for a, b, _ in links):
        return np.array(costs) > 0
    return min_cut(np.array(costs), links)


def _cost(features: tuple[int, ...], weights: np.ndarray) -> float:
    known = weights_cache.setdefault(id(weights), (weights, {}))[1]
    if features not in known:
        if len(known) > 500_000:
            known.clear()
        known[features] = float(weights[list(features)].sum())
    return known[features]


weights_cache: dict[int, tuple[np.ndarray, dict[tuple[int, ...], float]]] = {}


# --- training -------------------------------------------------------------------------------

# {w}: a word, {s}: words, {n}: a number, {l}: a plain line. Constructs stand between spaces or on lines of their own.
MARKED = {
    "html": ("<b>{w}</b>", "<i>{w}</i>", "<p class=\"{w}\">{l}</p>", "<br/>", "<li>{s}</li>", "<a href=\"#{w}\">{n}</a>", "&nbsp;", "&mdash;", "&#8212;", "<!-- {s} -->", "<td>{w}</td>", "<SPAN CLASS={w}>{s}</SPAN>", "<?xml version=\"1.0\"?>", "</ul>", "<img src=\"{w}.png\" alt=\"{w}\">", "<{w}>{s}</{w}>", "<{w}> {s} </{w}>", "<div>", "</p>", "{s} <a href=\"{w}", "&amp;", "<style>\n.{w} {{ {w}: {n}px; }}\n</style>", "<h2>{s}</h2>", "<!DOCTYPE html>", "<em>{w}</em>", "&lt;", "&eacute;", "&#x2014;"),
    "markdown": ("\n## {s}\n", "\n# {s}\n", "**{w}**", "*{w}*", "_{w}_", "\n- {s}\n- {s}\n", "\n* {s}\n* {s}\n", "\n+ {s}\n", "\n{n}. {s}\n", "\n> {l}\n", "[{s}]({w}.md)", "![{s}]({w}.png)", "[^{n}]", "\n[^{n}]: {s}\n", "\n| {w} | {w} |\n| --- | --- |\n| {w} | {n} |\n", "`{w}`", "\n{s}\n=======\n", "\n{s}\n-------\n", "~~{w}~~", "\n***\n", "\n```\n{w} = {w}({n})\n```\n", "\n~~~\n{s}\n~~~\n"),
    "wiki": ("[[{s}]]", "[[{s}|{w}]]", "''{w}''", "'''{w}'''", "\n== {s} ==\n", "\n=== {s} ===\n", "{{{{{w}|{w}={w}}}}}", "\n{{| class={w}\n! {w} !! {w}\n|-\n| {w} || {n}\n|}}\n"),
    "latex": ("\\textit{{{w}}}", "\\section{{{s}}}", "$x_{{{n}}} = {n}$", "$$\\sum {n}$$", "\\[ a^2 + b \\]", "\\begin{{itemize}}\n\\item {s}\n\\end{{itemize}}", "\\&", "caf\\'{{e}}", "{s} \\\\\n", "\\ldots{{}}", "\\footnote{{{s}}}", "\\label{{{w}}}", "$\\alpha$"),
}
PLAIN = ("it cost ${n} then, and ${n} now", "{n} < {n} and {n} > {n}", "I <3 {w} -> {w}", "{w}&{w};", "Q&A;", "R&D at", "C:\\{w}\\{w}", "[{n}]", "[{w}]", "#{n}", "{w}_{w}_{w}", "{n} * {n} * {n}", "x = {n} and y == {n}", "{{{s}}}", "'{w} {w}'", "{n} > {n}", "-{n}", "{w}/{w}", "<{w}>", "see <{w} {w}> there", "<{w}>", "write to <{w}>", "the <{w}>{s}", "<{w}>, <{w}>", "<{w}>{w}", "&{w};", "from ${n} to ${n}", "a ${n} or ${n} note", "${n}-${n}$", "the $ {w} $ sign", "a $5 bill and {w} $6 more$", "({w} $ {w})", "{w} -> {w}", "{n}*{n}*{n}", "[sic]", "[{n}]", "{w} #{n}", "\\\\{w}\\{w}", "D:\\{w}")


def fill(pattern: str, draw: np.random.Generator, lines: list[str], words: list[str]) -> str:
    """The pattern with its places filled; a name that stands in ``<{w}>…</{w}>`` is the same at both ends."""
    pick = lambda a: a[int(draw.integers(0, len(a)))]
    out = pattern
    if "<{w}>" in out and "</{w}>" in out:
        name = pick(words).lower()
        out = out.replace("<{w}>", f"<{name}>").replace("</{w}>", f"</{name}>")
    for sign, make in (("{w}", lambda: pick(words).lower()), ("{s}", lambda: " ".join(pick(words) for _ in range(int(draw.integers(2, 5))))), ("{n}", lambda: str(int(draw.integers(1, 99)))), ("{l}", lambda: pick(lines))):
        while sign in out:
            out = out.replace(sign, make(), 1)
    return out.replace("{{", "{").replace("}}", "}")


def made_text(draw: np.random.Generator, lines: list[str], words: list[str], positive: bool) -> tuple[str, int, int]:
    """A line with a construct or a look-alike set into it, and where that stands."""
    pick = lambda a: a[int(draw.integers(0, len(a)))]
    inserted = fill(pick([x for v in MARKED.values() for x in v] if positive else PLAIN), draw, lines, words)
    line = pick(lines)
    cut = pick([m.start() for m in re.finditer(" ", line)] or [len(line)])
    return line[:cut] + (inserted if inserted.startswith("\n") else " " + inserted) + line[cut:], cut, cut + len(inserted) + 1


def ground(lines: list[str]) -> tuple[list[str], list[str]]:
    """Lines and words to make texts of."""
    lines = [x for x in lines if x] or ["plain words stand here and there"]
    return lines, sorted({w for x in lines for w in re.findall(r"[A-Za-z]{3,}", x) if w.lower() not in TAGS}) or ["word"]


def train(lines: list[str], rounds: int = 6000, epochs: int = 5, rate: float = 0.4, seed: int = 5) -> np.ndarray:
    """Weights of a hashed logistic regression over candidates of made texts."""
    draw = np.random.default_rng(seed)
    lines, words = ground(lines)
    rows: list[list[int]] = []
    labels: list[int] = []
    for k in range(rounds):
        text, low, high = made_text(draw, lines, words, k % 2 == 0)
        for c in candidates(text):
            if c.start < high and c.end > low:
                rows.append(list(c.features))
                labels.append(int(k % 2 == 0))
    weights, gathered = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            r = rows[i]
            g = 1 / (1 + np.exp(-weights[r].sum())) - labels[i] + 1e-4 * weights[r]
            gathered[r] += g * g
            weights[r] -= rate * g / np.sqrt(gathered[r])
    return weights


def fit(texts: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights; of about ``sample`` texts, by a hash of their key, the plain lines come to the driver."""
    share = sample / max(texts.count(), 1)
    chosen = texts.filter(F.pmod(F.xxhash64("source_table", "item_key"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).select(F.substring("text", 1, 20_000).alias("text"))
    lines = [x.strip() for r in chosen.filter("text IS NOT NULL").collect() for x in normal_ends(r["text"]).split("\n")]
    return train(sorted({x for x in lines if 20 < len(x) < 400 and not re.search(r"[^\w\s.,;:?!\"'—-]", x)}))


# --- results --------------------------------------------------------------------------------


def marked(text: str | None, weights: np.ndarray) -> list[Candidate]:
    if not text or not text.strip():
        return []
    found = candidates(text)
    return [c for c, m in zip(found, label(found, weights)) if m]


def families(text: str | None, weights: np.ndarray) -> list[str]:
    return sorted({c.family for c in marked(normal_ends(text), weights)}) if text else []


def _render(text: str, c: Candidate) -> str:
    inner = text[c.start : c.end]
    form, family = c.form, c.family
    if family == "html":
        if form == "entity":
            return html.unescape(inner)
        name, closing = _tag_name(text, c), inner.startswith("</")
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return "\t" if closing else ""
        if name == "pre":
            return "\n```\n"
        return "\n" if name in ("br", "p", "div", "tr", "ul", "ol", "table", "blockquote", "hr") else ""
    if family == "wiki":
        if form == "link":
            body = inner[2:-2]
            return "" if re.match(r"(?i)(file|image|category):", body) else body.rsplit("|", 1)[-1]
        if form == "heading":
            depth = len(inner) - len(inner.lstrip("="))
            return "#" * depth + " " + inner.strip().strip("=").strip()
        if form == "emphasis":
            return inner.strip("'")
        if form == "table":
            if inner[:2] in ("{|", "|}", "|-"):
                return ""
            return "\t".join(x.strip() for x in re.split(r"\|\||!!", inner.lstrip("|!+")))
        return ""
    if family == "latex":
        if form in ("display", "inline"):
            return inner
        if form == "accent":
            return ""
        if form == "escape":
            return inner[1:] if inner[1:] != "\\" else ""
        m = re.match(r"\\((?:sub)*)(?:section|chapter|paragraph)", inner)
        if m:
            return "\n" + "#" * (1 + m.group(1).count("sub")) + " "
        return "- " if inner.startswith("\\item") else ""
    if form in ("strong", "emphasis", "struck"):
        return inner.strip("*_~")
    if form == "link":
        return inner[1 : inner.index("](")]
    if form == "image":
        return ""
    if form == "setext":
        title, line = inner.rsplit("\n", 1)
        return ("# " if line[0] == "=" else "## ") + title.strip()
    if form == "quote":
        return inner.lstrip(" >")
    if form == "item":
        return "- " if not inner.strip()[0].isdigit() else inner.strip() + " "
    if form == "row":
        return "" if not re.search(r"[^\s|:-]", inner) else "\t".join(x.strip() for x in inner.strip().strip("|").split("|"))
    if form == "rule":
        return ""
    if form in ("note", "definition"):
        return "" if form == "note" else inner[2:-2] + ". "
    return inner


def clean(text: str | None, weights: np.ndarray) -> str | None:
    """The text without markup, its structure kept; inner candidates are rendered before outer ones."""
    if not text or not text.strip():
        return text
    text = normal_ends(text)
    chosen = marked(text, weights)
    closers = {c.end - 1 for c in chosen if c.family == "latex" and text[c.end - 1 : c.end] == "{"}
    drop, opened = set(), []  # the braces that end the arguments of commands
    for m in re.finditer("[{}]", text) if closers else ():
        if m.group() == "{":
            opened.append(m.start())
        elif opened and opened.pop() in closers:
            drop.add(m.start())

    def part(low: int, high: int, own: list[Candidate]) -> str:
        out, at, i = [], low, 0
        plain = lambda a, b: "".join(text[k] for k in range(a, b) if k not in drop) if drop else text[a:b]
        while i < len(own):
            c = own[i]
            inside = []
            i += 1
            while i < len(own) and own[i].start < c.end:
                inside.append(own[i])
                i += 1
            out.append(plain(at, c.start))
            rendered = _render(text, c)
            for x in inside:
                rendered = rendered.replace(text[x.start : x.end], _render(text, x), 1)
            out.append(rendered)
            at = max(c.end, at)
        out.append(plain(at, high))
        return "".join(out)

    lines = [x.rstrip() for x in part(0, len(text), chosen).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def texts(spark: SparkSession, directory: str) -> DataFrame:
    """(source_table, item_key, text) of both tables, repeated rows included."""
    documents = table(spark, directory, "documents_md").select("doc_id", "content")
    replies = table(spark, directory, "transcriptions").select("reply_id", "markdown_text")
    return documents.select(F.lit("documents_md").alias("source_table"), F.col("doc_id").alias("item_key"), F.col("content").alias("text")).unionByName(
        replies.select(F.lit("transcriptions").alias("source_table"), F.col("reply_id").cast("string").alias("item_key"), F.col("markdown_text").alias("text"))
    )


def find_markup(frame: DataFrame, weights: np.ndarray) -> DataFrame:
    """(source_table, item_key, markup): each family of which a text holds a construct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, k, f) for t, k, x in zip(*(batch.column(n).to_pylist() for n in ("source_table", "item_key", "text"))) for f in families(x, weights)]
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["source_table", "item_key", "markup"])

    return frame.select("source_table", "item_key", "text").mapInArrow(run, "source_table string, item_key string, markup string")


def clean_texts(frame: DataFrame, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean(x, weights) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source_table"), batch.column("item_key"), pa.array(done, pa.string())], names=["source_table", "item_key", "clean_text"])

    return frame.select("source_table", "item_key", "text").mapInArrow(run, "source_table string, item_key string, clean_text string")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    everything = texts(spark, directory)
    return find_markup(everything, fit(everything)).distinct()


def p3_clean(spark: SparkSession, directory: str) -> DataFrame:
    """Every record's clean text."""
    everything = texts(spark, directory)
    return clean_texts(everything, fit(everything)).dropDuplicates(["source_table", "item_key"])
