"""Problem 1: noise in the text of scanned pages.

Words are decoded jointly over the de-lined character stream. A stream is cut into atoms at blanks,
line ends and hyphens; the cheapest path over the atoms may join any number of them (a hyphen or a
line end inside a word, a word torn apart), split one (words grown together), and read a word through
confusions of misread characters. Known words are cheap, unknown ones cost by their length. A
stretch that is decoded reaches from the first to the last atom around something unknown or a hyphen
at a line end; tokens that can be no part of any noise are looked up once per worker, since most text
is plain. Readings are searched in a tree of the known words, character by character, so neither the
length of a token nor the number of its possible forms needs a limit.

The known words are counted over the whole corpus, together with the given word list. A word of
the corpus is known from a fixed share of all words on (``KNOWN_SHARE``), so the lexicon that every
worker holds has at most 1 / KNOWN_SHARE entries whatever the size of the corpus; a frequent word
that is a confusion of a far more frequent one is taken out again. Running headers are counted per
file, and what looks like one inside other items is joined with that table. Paragraph boundaries
are chosen by dynamic programming over the lines of an item and the seams between items.

Defined results: null, empty and blank texts have no noise; an item delivered twice counts once;
null labels are labels that are neither header nor footer; an unknown word without a reading as a
known one is left alone; order is by file and position, ties by item.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut_lineage, table

KNOWN_SHARE = 2e-5
RARER = 8
MOST_OPERATIONS = 3

# What is read -> what was printed.
CONFUSIONS = (
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("i", "l"), ("l", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"),
    ("9", "g"), ("2", "z"), ("ſ", "s"), ("ſ", "f"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("v", "y"), ("y", "v"), ("li", "h"), ("ii", "u"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("nn", "m"), ("m", "nn"), ("in", "m"), ("ä", "a"),
    ("ö", "o"), ("ü", "u"), ("é", "e"), ("f", "t"), ("t", "f"), ("u", "n"), ("n", "u"),
)
HARD = frozenset("1|!0568924ſäöüé")  # characters that do not stand inside plain words
STRAY = frozenset("\\~°■^|¦§¤¬`_=<>#%{}□▪●◦¨´")
EDGE = ".,;:?\"'()[]—–-“”‘’„»«…*•"
HYPHENS = "-¬­‐‑"

BREAK = re.compile(rf" ?[{HYPHENS}]\s+(?=\S)")
VISIBLE = re.compile(r"\S+")
BLANK_LINE = re.compile(r"\n[ \t]*\n")
INNER = re.compile(rf"[{HYPHENS}]")
ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
PAGE_NUMBER = re.compile(r"\W*(?:(?:p|pp|page)\b\.?\s*)?(\d{1,4}|[ivxl]{1,7})[\s.\])\-–—]*", re.I)
ISOLATED = re.compile(r"(?:\A|\n)[ \t]*\n([^\n]+)(?=\n[ \t]*(?:\n|\Z))")
# numbers in a form that only pages have
INLINE_NUMBER = re.compile(r"(?<=\s)(?:p\. (\d{1,4})|Page (\d{1,4})|- (\d{1,4}) -|\[(\d{1,4})\])(?=\s)")
TWO_CAPITALS = re.compile(r"[A-Z]{2}|[A-Z] +[A-Z] ")
CAPITALS = re.compile(r"(?:\d{1,4}[ \t]+)?(?:[A-Z][A-Z0-9'’|!]*(?:[ \t]+|(?=\n|\Z))){2,}(?:\d{1,4}\b)?|(?:\d{1,4}[ \t]+)?(?:[A-Z'’][ \t]+){4,}[A-Z](?:[ \t]+\d{1,4}\b)?")
BULLET_TITLE = re.compile(r"\d{1,4} • [A-Z][^\n•]{3,}|[A-Z][^\n•.]{3,} • \d{1,4}")
TITLE_RUN = re.compile(r"\b[A-Z][a-z'’]*(?:[ \t]+(?:of|for|and|the))*(?:[ \t]+[A-Z][a-z'’]*(?:[ \t]+(?:of|for|and|the))*)*[ \t]+[A-Z][a-z'’]+")


@lru_cache(maxsize=4096)
def plain_label(label: str | None) -> str:
    return re.sub(r"[^a-z]", "", label.lower()) if label else ""


NOT_LETTERS = re.compile(r"[^a-z]+")
PAGE_WORD = re.compile(r"^\W*(?:p|page)\b")


def header_key(text: str) -> str:
    """Letters alone, so that spacing, case, marks and the page number of a header do not matter."""
    low = text.lower()
    if "p" in low[:4]:
        low = PAGE_WORD.sub("", low)
    return NOT_LETTERS.sub("", low)


def broken_words(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, left half, right half) of everything around a hyphen before a blank or line end."""
    out: list[tuple[int, int, str, str]] = []
    if not any(h in text for h in HYPHENS):
        return out
    for m in BREAK.finditer(text):
        at = m.start()
        start = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
        if start < at and (not out or start >= out[-1][1]):
            right = VISIBLE.match(text, m.end())
            if any(map(str.isalpha, text[start:at])):
                out.append((start, right.end(), text[start:at], right.group()))
    return out


def without(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    if not spans:
        return text
    parts, at = [], 0
    for start, end, _, _ in spans:
        parts.append(text[at:start])
        at = end
    return " ".join([*parts, text[at:]])


def is_page_number(text: str) -> int | None:
    """The number if a text is nothing but a page number; chapter numerals in capitals are none."""
    m = PAGE_NUMBER.fullmatch(text.strip())
    if not m:
        return None
    n = m.group(1)
    if n.isdigit():
        return int(n)
    if not n.islower() or not ROMAN.fullmatch(n):
        return None
    total, last = 0, 0
    for c in reversed(n):
        v = {"i": 1, "v": 5, "x": 10, "l": 50}[c]
        total, last = total + (v if v >= last else -v), max(v, last)
    return total


def core_of(token: str) -> str:
    core = token.strip(EDGE).lower()
    return core[:-2] if core.endswith(("'s", "’s")) else core


ATOM = re.compile(rf"[^{HYPHENS}\s—–/]+")
AROUND = 2  # atoms beside an unknown one that are decoded with it
INSIDE = {"h": 0.5, "-": 3.0, "n": 6.0, "s": 7.0}  # what a seam inside a word costs


class Decoder:
    """Reads words and streams with a lexicon of known words and their logarithmic costs."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.fine: set[str] = set()  # tokens that are no part of any noise, whatever stands beside them
        self.start: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for read, printed in CONFUSIONS:
            self.start[read[0]].append((read, printed))
        self.tree: dict = {}
        self.by_size: dict[int, float] = {}
        for w, cost in lexicon.items():
            self.learn(w, cost)
            self.by_size[len(w)] = min(self.by_size.get(len(w), math.inf), cost)
        self.reach = 2 * max(self.by_size, default=0)  # a confusion takes one character away at most, and half of them are read as they stand
        self.every = "\n".join(lexicon)
        self.word = lru_cache(maxsize=400_000)(self.read_word)
        self.decode = lru_cache(maxsize=200_000)(self._decode)
        self.judge = lru_cache(maxsize=1_000_000)(self._judge)
        self.alone = lru_cache(maxsize=1_000_000)(self._alone)
        self.atom = lru_cache(maxsize=1_000_000)(self._atom)
        self.segments = lru_cache(maxsize=400_000)(self._segments)
        self.least = lru_cache(maxsize=4096)(self._least)

    def learn(self, word: str, cost: float) -> None:
        node = self.tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = self.lexicon[word] = cost

    def forget(self, word: str) -> float:
        node = self.tree
        for c in word:
            node = node[c]
        del node[""]
        return self.lexicon.pop(word)

    @staticmethod
    def operations(n: int) -> int:
        """How many confusions a token of n characters may hold: one if it is short, else three or half of it."""
        return 1 if n <= 3 else max(MOST_OPERATIONS, n // 2)

    def _least(self, n: int) -> float:
        """Of the words that n characters can be read as: a confusion changes the length by one at most."""
        most = self.operations(n)
        return min((self.by_size.get(k, math.inf) for k in range(n - most, n + most + 1)), default=math.inf)

    def read_word(self, token: str) -> tuple[float, str, int]:
        """(cost, reading, confusions) of one word; the fewest confusions first, then the commonest word."""
        known = self.lexicon.get(token)
        if known is not None:
            return known, token, 0
        n = len(token)
        most = self.operations(n)
        layer: dict[tuple[int, int], tuple[int, dict, str]] = {(0, 0): (0, self.tree, "")} if n > 1 else {}
        for operations in range(most + 1):
            grown: dict[tuple[int, int], tuple[int, dict, str]] = {}
            best: tuple[float, str] | None = None
            for at, node, done in layer.values():
                while node is not None:  # as the characters stand, and at each place through one confusion more
                    if at == n:
                        if "" in node and (len(done) > 3 or operations == 1):
                            best = min(best, (node[""], done)) if best else (node[""], done)
                        break
                    if operations < most:
                        for read, printed in self.start.get(token[at], ()):
                            if token.startswith(read, at):
                                follow = node
                                for c in printed:
                                    follow = follow.get(c)
                                    if follow is None:
                                        break
                                else:
                                    grown[at + len(read), id(follow)] = (at + len(read), follow, done + printed)
                    done += token[at]
                    node = node.get(token[at])
                    at += 1
            if best:
                return best[0] + 3.0 * operations, best[1], operations
            layer = grown
        return 8.0 + n, token, 0

    def _segments(self, atom: str) -> tuple[float, str] | None:
        """(cost, words) of the cheapest way to read an atom as two or more known words of two letters or more; None without one."""
        n = len(atom)
        if n <= 5:
            return None
        best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * n
        for i in range(n - 1):
            if best[i] is None:
                continue
            node = self.tree
            for k in range(i, n):
                node = node.get(atom[k])
                if node is None:
                    break
                if "" in node and k > i and (i or k + 1 < n):
                    cost = best[i][0] + node[""] + (7.0 if i else 0.0)
                    if best[k + 1] is None or cost < best[k + 1][0]:
                        best[k + 1] = (cost, i)
        if best[n] is None:
            return None
        words, at = [], n
        while at:
            words.append(atom[best[at][1] : at])
            at = best[at][1]
        return best[n][0], " ".join(reversed(words))

    def _decode(self, atoms: tuple[str, ...], seams: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[bool, ...], int]:
        """The cheapest words over the atoms: (words, whether each seam is inside a word, confusions).

        Seams: ``h`` a hyphen at a line end or blank, ``-`` a hyphen within a line, ``n`` a line end, ``s`` a blank.
        """
        n = len(atoms)
        best: list[tuple[float, int, str, int]] = [(0.0, 0, "", 0)] + [(math.inf, 0, "", 0)] * n
        for j in range(n):
            joined, paid = "", 0.0
            for k in range(j + 1, n + 1):
                joined += atoms[k - 1]
                if k - 1 > j:
                    if len(joined) > self.reach and k - 2 > j:
                        break
                    paid += INSIDE[seams[k - 2]]
                    if joined not in self.lexicon and any(x in "ns" for x in seams[j : k - 1]):
                        # through a blank or line end a misread letter must be sure, and the word be cheaper than its atoms
                        if HARD.isdisjoint(joined):
                            continue
                        if self.least(len(joined)) + 3.0 + paid > sum(self.word(a)[0] for a in atoms[j:k]) + 3.0 * sum(x in "h-" for x in seams[j:k]):
                            continue
                cost, reading, operations = self.word(joined)
                if operations == 0 and k == j + 1 and joined not in self.lexicon:
                    grown = self.segments(joined)  # words grown together
                    if grown and grown[0] + 7 < cost:
                        cost, reading = grown[0] + 7, grown[1]
                compound = 0.0
                if j and seams[j - 1] in "h-":
                    compound = 1.0 if f"{best[j][2]}-{joined}" in self.lexicon else 3.0
                if k - 1 > j and all(x in "h-" for x in seams[j : k - 1]):
                    spelled = "-".join(atoms[j:k])  # a word that is written with its hyphen
                    if spelled in self.lexicon and self.lexicon[spelled] < cost:
                        cost, reading, operations, paid = self.lexicon[spelled], spelled, 0, 1.0
                total = best[j][0] + cost + paid + compound
                if total < best[k][0]:
                    best[k] = (total, j, reading, operations)
        words, cuts, operations, k = [], {0, n}, 0, n
        while k:
            _, j, reading, used = best[k]
            words.append(reading)
            operations += used
            cuts.add(k)
            if "-" in reading:
                cuts.update(range(j, k))
            k = j
        return tuple(reversed(words)), tuple(i + 1 not in cuts for i in range(n - 1)), operations

    def _alone(self, token: str) -> bool:
        """Whether a blank-free token is sure to be no part of a joined word and no two words grown together."""
        low = core_of(token)
        if INNER.search(low):
            return all(p in self.lexicon for p in INNER.split(low.strip(HYPHENS))) and len(INNER.findall(low)) < 2 and self.judge(token) != "broken"
        if low in self.lexicon or self.judge(low) == "ok":
            return True
        return HARD.isdisjoint(low) and low not in self.every and self.segments(low) is None

    def settled(self, atoms: list[str], seams: list[str | None]) -> bool:
        """Whether ``decode`` is sure to give no word that ``_joined`` takes: looked up, without trying confusions.

        A word over several atoms that is read through confusions costs at least one of them, its
        seams and the commonest word of about its length; where the atoms by themselves cost less, it is not the cheapest path.
        """
        for j, atom in enumerate(atoms):
            if atom not in self.lexicon and self.segments(atom):
                return False
            whole, paid, compound = atom, 0.0, 0.0
            for k in range(j + 1, len(atoms)):
                seam = seams[k - 1]
                whole, paid, compound = whole + atoms[k], paid + INSIDE[seam], compound + 3.0 * (seam in "h-")
                if whole in self.lexicon:
                    return False
                if len(whole) > self.reach:
                    break
                through = all(x in "h-" for x in seams[j:k])
                if through or not HARD.isdisjoint(whole):
                    single = sum(self.word(a)[0] for a in atoms[j : k + 1])
                    after = 3.0 * (k < len(seams) and seams[k] in "h-")
                    if seam == "h" and through and single + compound + after >= 8.0 + len(whole) + paid:
                        return False  # a word that is unknown as a whole too
                    if single + compound + after >= self.least(len(whole)) + 3.0 + paid:
                        return False
        return True

    def _atom(self, atom: str) -> tuple[str, int, str, bool, bool, bool, bool]:
        """(core in lower case, where it begins, the core, is a word, is unknown, begins the atom, ends it)."""
        core = atom.strip(EDGE)
        low = core.lower()
        if low.endswith(("'s", "’s")):
            core, low = core[:-2], low[:-2]
        word = bool(low) and all(c.isalpha() or c in HARD for c in low) and any(c.isalpha() for c in low)
        unknown = word and len(low) > 1 and low not in self.lexicon and self.judge(low) != "ok"
        return low, atom.index(core) if core else 0, core, word, unknown, atom.startswith(core), atom.endswith(core)

    def suspects(self, text: str) -> set[str]:
        """The blank-free tokens of a text that are not sure to be plain."""
        rest = set(text.split()) - self.fine
        plain = {t for t in rest if t[-1] not in HYPHENS and self.judge(t) in ("ok", "unknown") and self.alone(t)}
        if len(self.fine) > 2_000_000:
            self.fine.clear()
        self.fine |= plain
        return rest - plain

    def _judge(self, token: str) -> str:
        """Of one blank-free token: ``ok``, ``glyph`` (sure), ``soft`` (by plain letters alone), ``stray``, ``unknown``."""
        core = token.strip(EDGE)
        if not core:
            return "ok"
        if all(c in STRAY for c in core):
            return "stray"
        low = core_of(token)
        if low in self.lexicon or len(low) < 2:
            return "ok"
        if "!" in low:
            bare = low.rstrip("!")
            if bare in self.lexicon:
                return "ok"
        if "—" in low or "–" in low or "/" in low:
            kinds = {self._judge(x) for x in re.split("[—–/]", low) if x}
            return next((k for k in ("glyph", "soft", "unknown") if k in kinds), "ok")
        if low[0] in STRAY or low[-1] in STRAY:  # a mark that stands close to a word, not a misread letter of it
            inner = low.strip("".join(STRAY))
            if inner in self.lexicon and self.word(low)[2] == 0:
                return "stray"
        if INNER.search(low):
            parts = [x for x in INNER.split(low) if x]
            if any(c in low for c in "¬­") and "".join(parts) in self.lexicon:
                return "broken"
            kinds = [self._judge(x) for x in parts]
            if any(k == "glyph" for k in kinds):
                return "glyph"
            if all(x.isdigit() for x in parts):
                return "ok"
            if len(parts) == 2 and all(p.isalpha() for p in parts):
                _, joins, _ = self.decode(tuple(parts), ("-",))
                if joins[0] and "".join(parts) in self.lexicon:
                    return "broken"
            return "soft" if "soft" in kinds else "ok"
        letters = sum(c.isalpha() for c in low)
        if not letters or (letters < 2 and low[0] not in HARD) or re.fullmatch(r"\d+(?:st|nd|rd|th|°|[a-z])?|[a-z]\d+|[a-z]\.?\d+", low):
            return "ok"
        if ROMAN.fullmatch(low):
            return "ok"
        folded = unicodedata.normalize("NFKC", low) if "ſ" not in low else low
        if folded != low and folded in self.lexicon:
            return "ok"
        _, reading, operations = self.word(low)
        if not operations or (len(reading) < 3 and HARD.isdisjoint(low)):
            return "unknown"
        hard = not HARD.isdisjoint(low) or any(c == "I" for c in core[1:] if not core.isupper())
        return "glyph" if hard else "soft"


_decoders: dict[int, Decoder] = {}


def shared_decoder(lexicon: dict[str, float]) -> Decoder:
    """The decoder of a lexicon; a worker that runs several tasks keeps it, with what it has looked up."""
    key = hash(frozenset(lexicon.items()))
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(lexicon)
    return _decoders[key]


SOFT_BREAK = re.compile(rf" ?[{HYPHENS}]\s+")


def _seam(gap: str) -> str | None:
    """The seam that stands for what is between two atoms; None where no word runs through."""
    if any(c in HYPHENS for c in gap):
        return "-" if len(gap) == 1 else "h" if SOFT_BREAK.fullmatch(gap) else None
    if any(c in "—–/" for c in gap):
        return None
    lines = gap.count("\n")
    return "s" if not lines else "n" if lines == 1 else None


def stretches(text: str, decoder: Decoder) -> list[tuple[int, int, str, tuple[str, ...], int]]:
    """(start, end, reading, seams within, confusions) of the words that are joined or split.

    The text is cut into atoms at blanks, line ends and hyphens, and every stretch around unknown
    atoms and hyphens at line ends is decoded at once. Marks between two atoms end a stretch. Words
    that come out as known ones count, and unknown ones that a hyphen at a line end divides; through
    blanks and line ends a misread letter must be sure. Single letters beside known words are left alone.
    """
    atoms = [(m.start(), m.end(), decoder.atom(m.group())) for m in ATOM.finditer(text)]
    known: dict[int, str | None] = {}

    def seam(k: int) -> str | None:
        if k not in known:
            (_, end, a), (start, _, b) = atoms[k], atoms[k + 1]
            known[k] = _seam(text[end:start]) if a[3] and b[3] and a[6] and b[5] else None
        return known[k]

    centres = {k for k, a in enumerate(atoms) if a[2][4]}
    if any(h in text for h in HYPHENS):  # beside a hyphen at a line end, in a word with two or more hyphens, or in one that is judged to be broken
        k = 0
        while k < len(atoms) - 1:
            last = k
            if text[atoms[k][1]] != " " or atoms[k + 1][0] - atoms[k][1] > 1:
                if seam(k) == "h":
                    centres |= {k, k + 1}
                while last < len(atoms) - 1 and seam(last) == "-":
                    last += 1
                if last - k > 1 or (last - k == 1 and decoder.judge(text[atoms[k][0] : atoms[last][1]]) == "broken"):
                    centres |= set(range(k, last + 1))
            k = max(last, k + 1)
    out, done = [], -1
    for centre in sorted(centres):
        if centre <= done:
            continue
        first = last = centre
        while first > 0 and centre - first < AROUND and seam(first - 1):
            first -= 1
        reach = centre
        while last < len(atoms) - 1 and last < reach + AROUND and seam(last):
            last += 1
            if last in centres:
                reach = last
        done = last
        if last > first or decoder.segments(atoms[centre][2][0]):
            bare = [(a[2][0], a[0] + a[2][1], a[2][2]) for a in atoms[first : last + 1]]
            out += _joined(decoder, bare, [seam(k) for k in range(first, last)])
    return out


def _joined(decoder: Decoder, bare: list[tuple[str, int, str]], seams: list[str]) -> Iterator[tuple[int, int, str, tuple[str, ...], int]]:
    atoms = [b[0] for b in bare]
    if decoder.settled(atoms, seams):
        return
    words, joins, _ = decoder.decode(tuple(atoms), tuple(seams))
    at, last = 0, len(bare) - 1
    for reading in words:
        end = at + reading.count("-")
        while end < last and joins[end]:
            end += 1
        within = tuple(seams[at:end])
        start, stop = bare[at][1], bare[end][1] + len(bare[end][2])
        if " " in reading:
            yield start, stop, reading, (), 0
        elif end > at and "-" not in reading and (reading in decoder.lexicon or set(within) == {"h"}):
            whole = "".join(b[0] for b in bare[at : end + 1])
            operations = decoder.word(whole)[2]
            if not operations or set(within) <= {"h", "-"} or not HARD.isdisjoint(whole):
                yield start, stop, reading, within, operations
        at = end + 1


def same_case(old: str, new: str) -> str:
    if len(old) > 1 and old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def redone(decoder: Decoder, text: str) -> tuple[str, list[tuple[tuple[str, ...], int, str]]]:
    """The text with joined and split words; (seams, confusions, what stood there) of each.

    A line end inside a word stands behind it then.
    """
    parts, at, done = [], 0, []
    for start, end, reading, within, operations in stretches(text, decoder):
        old = text[start:end]
        solid = re.sub(rf"[{HYPHENS}\s]", "", old)
        parts += [text[at:start], solid if within and not operations else same_case(solid, reading)]
        done.append((within, operations, old))
        at = end
        if "\n" in old:
            tail = re.match(r"\S*", text[end:]).group()
            parts += [tail, "\n"]
            at = end + len(tail)
            at += len(re.match(r"[ \t]?", text[at:]).group())
    return ("".join([*parts, text[at:]]) if done else text), done


def words_for_lexicon(text: str) -> list[str]:
    """Tokens of a text without the halves of broken words and a first token that may be one."""
    tokens = without(text, broken_words(text)).split()
    return tokens[1:] if tokens and tokens[0][0].islower() else tokens


def _headerlike(text: str) -> bool:
    return "\n" not in text.strip() and text.strip()[-1:] not in ".,;:!?\"" and len(header_key(text)) >= 5


def count_corpus(items: DataFrame) -> DataFrame:
    """(kind, file, key, n, lo, hi): words (``w``) of the corpus and header-like texts (``h``) of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()
        headers: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for item, file, label, text, foot in zip(*(batch.column(n).to_pylist() for n in ("item_id", "file", "label", "text", "footnote_text"))):
                if text:
                    raw.update(words_for_lexicon(text))
                    if text.strip() and _headerlike(text):
                        seen = headers.setdefault((file, header_key(text)), [0, item, item])
                        seen[0] += plain_label(label) == "pageheader"
                        seen[1], seen[2] = min(seen[1], item), max(seen[2], item)
                if foot and foot != text:
                    raw.update(words_for_lexicon(foot))
        words: Counter[str] = Counter()
        for token, n in raw.items():
            core = core_of(token)
            if core and any(c.isalpha() for c in core):
                words[core] += n
        rows = [("w", None, w, n, 0, 0) for w, n in words.items()] + [("h", f, k, v[0], v[1], v[2]) for (f, k), v in headers.items()]
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "file", "key", "n", "lo", "hi"]
        )

    counted = items.select("item_id", "file", "label", "text", "footnote_text").mapInArrow(run, "kind string, file string, key string, n bigint, lo bigint, hi bigint")
    return counted.groupBy("kind", "file", "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def learn_lexicon(counted: DataFrame, wordlist: DataFrame, share: float = KNOWN_SHARE) -> dict[str, float]:
    """Costs of the known words; at most 1 / share rows and the fixed word list come to the driver."""
    words = counted.filter("kind = 'w'")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = {r["key"]: r["n"] for r in words.filter(F.col("n") >= max(2.0, total * share)).select("key", "n").collect()}
    given = {r["word"].lower() for r in wordlist.filter(F.col("word").isNotNull()).select("word").distinct().collect()}
    return build_lexicon(frequent, given, total)


def build_lexicon(frequent: dict[str, int], given: set[str], total: int) -> dict[str, float]:
    def cost(n: int) -> float:
        return min(4.0, 0.25 * math.log((total + 1) / (n + 1)))

    lexicon = {w: cost(frequent.get(w, 0)) for w in given}
    plain = {w: n for w, n in frequent.items() if w not in given and not any(c in HARD or c in STRAY for c in w) and len(w) > 1 and any(c.isalpha() for c in w)}
    lexicon |= {w: cost(n) for w, n in plain.items()}
    decoder = Decoder(lexicon)
    for w, n in sorted(plain.items(), key=lambda x: (x[1], x[0])):
        own = decoder.forget(w)
        _, reading, operations = decoder.read_word(w)
        many = frequent.get(reading, 0)
        if not operations or (many < RARER * n and reading not in given) or operations > 2:
            decoder.learn(w, own)
    return lexicon


def letters_at_end(text: str) -> str:
    at = len(text)
    while at and text[at - 1].isalpha():
        at -= 1
    return text[at:]


def item_noise(decoder: Decoder, text: str, page: int | None, label: str) -> tuple[bool, bool, bool, list[str], str | None]:
    """(hyphen, glyph, clutter, keys that may be running headers, an unproved half word at the end)."""
    hyphen = glyph = clutter = False
    tail = None
    judge = decoder.judge
    words = text.rstrip()
    if words and words[-1] in HYPHENS:
        before = words[:-1].removesuffix(" ")
        half, sign = letters_at_end(before).lower(), words[-1:]
        if half:
            if sign in "¬­" or (half not in decoder.lexicon and decoder.word(half)[2] == 0 and len(half) > 1):
                hyphen = True
            else:
                tail = half
            words = before[: len(before) - len(half)]
    if decoder.suspects(words):
        words, done = redone(decoder, words)
        for within, operations, old in done:  # torn and grown words as such are no kind of noise
            hyphen |= "h" in within or "-" in within
            glyph |= operations > 0 and not HARD.isdisjoint(old.lower())
        spans = broken_words(words)  # hyphens that no stretch goes through, and those of words written with one
        for _, _, left, right in spans:
            left, right = re.split("[—–]", left)[-1].strip(EDGE + "-").lower(), core_of(re.split("[—–]", right)[0])
            left = INNER.split(left)[-1] if INNER.search(left) else left
            if not left or not right or not right[0].isalpha() or not left[-1].isalpha():
                continue
            _, joins, operations = decoder.decode((left, right), ("h",))
            if joins[0]:
                hyphen = True
                glyph |= operations > 0 and not HARD.isdisjoint(left + right)
            else:
                glyph |= "glyph" in {judge(left), judge(right)}
        words = without(words, spans)
        tokens = words.split()
        first = tokens[0] if tokens and tokens[0][:1].islower() else None
        for t in set(tokens) - decoder.fine:
            kind = judge(t)
            if kind == "broken":
                hyphen = True
            elif kind == "soft":
                glyph |= t != first or len(core_of(t)) >= 5  # a short first token may be the second half of a broken word
            elif kind == "stray":
                glyph |= len(tokens) > 1
            elif kind == "glyph":
                glyph = True
    keys: list[str] = []
    if label not in ("pageheader", "pagefooter"):
        clutter, keys = find_clutter(text, page, label)
    return hyphen, glyph, clutter, keys, tail


TWO_SMALL = re.compile("[a-z]{2}")


def _capitals(line: str) -> bool:
    """A line of two or more words, all in capitals, that is no closing line."""
    if TWO_SMALL.search(line):
        return False
    words = re.findall(r"[^\W\d_]{2,}", line)
    return len(words) >= 2 and all(w.isupper() for w in words) and header_key(line) not in ("theend", "finis")


def _titled(line: str) -> bool:
    words = re.findall(r"[^\W\d_]{2,}", line)
    return len(words) >= 2 and all(w[0].isupper() or w in ("of", "for", "and", "the", "in", "on", "to", "an") for w in words)


def find_clutter(text: str, page: int | None, label: str) -> tuple[bool, list[str]]:
    """Whether page furniture is proved by its form, and keys of what may be a running header."""
    stripped = text.strip()
    if is_page_number(stripped) is not None:
        return True, []
    keys: set[str] = set()
    if _headerlike(stripped) and not any(len(w) > 4 and w.islower() for w in stripped.split()):
        numbered = bool(re.search(r"(?:^|\s)\d{1,4}(?:\s|$)", stripped)) and not re.match(r"\d{1,3}[.)]", stripped)
        if numbered and page is not None and label not in ("listitem", "footnote") and re.search(rf"(?:^|\s){page}(?:\s|$)", stripped) and _titled(stripped):
            return True, []
        if not (page == 1 and label == "sectionheader" and not numbered):
            keys.add(("#" if numbered else "=") + header_key(stripped))
    else:
        if BLANK_LINE.search(text):
            for m in ISOLATED.finditer(text):
                line = m.group(1).strip()
                if is_page_number(line) is not None or _capitals(line):
                    return True, []
                keys.add(header_key(line))
        if "\n" in stripped:
            for line in stripped.split("\n"):
                if line[:1] in "-[pP0123456789" and line and is_page_number(line) == page and page is not None:
                    return True, []
                if len(line) > 8 and line.isupper() and _capitals(line):
                    return True, []
        for m in INLINE_NUMBER.finditer(text):
            if int(next(g for g in m.groups() if g)) == page:
                return True, []
        if TWO_CAPITALS.search(text):
            for m in CAPITALS.finditer(text):
                if page is not None and re.search(rf"(?:^|\s){page}(?:\s|$)", m.group().strip()) and _capitals(m.group()):
                    return True, []
                keys.add(header_key(m.group()))
        for m in TITLE_RUN.finditer(text):
            run = m.group()
            keys.add(header_key(run))
            if run.count(" ") > 1:
                keys.add(header_key(run.split(None, 1)[1]))
                keys.add(header_key(run.rsplit(None, 1)[0]))
        if "•" in text:
            for m in BULLET_TITLE.finditer(text):
                words = m.group().split()
                keys |= {header_key(" ".join(words[:k])) for k in range(3, len(words) + 1)}
    return False, sorted(k for k in keys if len(k.lstrip("#=")) >= 5)


def detect(items: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(item_id, kind, file, idx, key): proved noise, and candidates for the joins that prove the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared_decoder(lexicon)
        for batch in batches:
            out: list[tuple] = []
            names = ("item_id", "file", "idx", "page_no", "label", "text", "footnote_text")
            for item, file, idx, page, label, text, foot in zip(*(batch.column(n).to_pylist() for n in names)):
                label = plain_label(label)
                kinds = set()
                if text and text.strip():
                    hyphen, glyph, clutter, keys, tail = item_noise(decoder, text, page, label)
                    kinds |= {k for k, v in (("hyphen", hyphen), ("glyph", glyph), ("clutter", clutter)) if v}
                    if not clutter:
                        out += [(item, "header", file, idx, k) for k in keys]
                    if tail and not hyphen:
                        out.append((item, "tail", file, idx, tail))
                    if label in BODY and text[0].islower():
                        out.append((item, "head", file, idx, core_of(text.split(None, 1)[0])))
                if foot and foot.strip():
                    hyphen, glyph, clutter, keys, tail = (foot == text and (False, False, False, [], None)) or item_noise(decoder, foot, page, "footnote")
                    if foot == text:
                        clutter, keys = find_clutter(foot, page, "footnote")
                    kinds |= {k for k, v in (("hyphen", hyphen), ("glyph", glyph), ("clutter", clutter)) if v}
                    if not clutter:
                        out += [(item, "header", file, idx, k) for k in keys]
                out += [(item, k, None, None, None) for k in kinds]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=["item_id", "kind", "file", "idx", "key"]
            )

    return items.select("item_id", "file", "idx", "page_no", "label", "text", "footnote_text").mapInArrow(run, "item_id bigint, kind string, file string, idx int, key string")


def header_looks(items: DataFrame) -> DataFrame:
    """(item_id, file, idx, key): what may be a running header in each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for item, file, idx, page, label, text, foot in zip(*(batch.column(n).to_pylist() for n in ("item_id", "file", "idx", "page_no", "label", "text", "footnote_text"))):
                label = plain_label(label)
                if text and text.strip() and label not in ("pageheader", "pagefooter"):
                    out |= {(item, file, idx, k.lstrip("#=")) for k in find_clutter(text, page, label)[1]}
                if foot and foot.strip():
                    out |= {(item, file, idx, k.lstrip("#=")) for k in find_clutter(foot, page, "footnote")[1]}
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()))], names=["item_id", "file", "idx", "key"])

    return items.select("item_id", "file", "idx", "page_no", "label", "text", "footnote_text").mapInArrow(run, "item_id bigint, file string, idx int, key string")


BODY = frozenset({"", "text", "paragraph"})
BLOCK = 2048


def _continued(candidates: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Items whose last word goes on in the next body item of their file that begins in lower case.

    Positions are looked through in blocks, with the first such item of the blocks behind carried back.
    """
    marks = candidates.filter("kind IN ('tail', 'head')").select(
        "item_id", "file", "idx", F.when(F.col("kind") == "tail", F.col("key")).alias("half"), F.when(F.col("kind") == "head", F.col("key")).alias("rest"), F.floor(F.col("idx") / BLOCK).alias("block")
    )
    behind = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    first = marks.groupBy("file", "block").agg(F.min_by("rest", F.when(F.col("rest").isNotNull(), F.col("idx"))).alias("first"))
    carried = first.select("file", "block", F.first("first", ignorenulls=True).over(behind).alias("carried"))
    after = Window.partitionBy("file", "block").orderBy("idx").rangeBetween(1, Window.unboundedFollowing)
    near = marks.withColumn("near", F.first("rest", ignorenulls=True).over(after)).filter("half IS NOT NULL")
    pairs = near.join(carried, ["file", "block"]).select("item_id", "half", F.coalesce("near", "carried").alias("rest")).filter("rest IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared_decoder(lexicon)
        for batch in batches:
            kept = [i for i, half, rest in zip(*(batch.column(n).to_pylist() for n in ("item_id", "half", "rest"))) if half + rest in lexicon and decoder.decode((half, rest), ("h",))[1][0]]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["item_id"])

    return pairs.mapInArrow(run, "item_id bigint").select("item_id", F.lit("hyphen").alias("noise"))


def find_noise(items: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(item_id, noise), each once."""
    counted = cut_lineage(count_corpus(items))
    lexicon = learn_lexicon(counted, wordlist)
    found = cut_lineage(detect(items, lexicon))
    headers = counted.filter("kind = 'h' and n > 0").select("file", "key", (F.col("lo") < F.col("hi")).alias("repeated"))
    looks = found.filter("kind = 'header'").select("item_id", "file", F.regexp_replace("key", "^[#=]", "").alias("key"), F.startswith("key", F.lit("=")).alias("whole"))
    clutter = looks.distinct().join(headers, ["file", "key"]).filter("repeated or not whole").select("item_id", F.lit("clutter").alias("noise"))
    proved = found.filter(F.col("kind").isin("hyphen", "glyph", "clutter")).select("item_id", F.col("kind").alias("noise"))
    return proved.unionByName(clutter).unionByName(_continued(found, lexicon)).distinct()


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return find_noise(table(spark, directory, "extracted_items"), table(spark, directory, "wordlist"))
