"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage.

Templates and texts are read as words (letters and digits, lower case). Of the
hashes of all runs of ``GRAM`` words, the least of every ``SPAN`` neighbours is
a fingerprint; a common stretch of ``GRAM + SPAN - 1`` words always shares
one. Templates too short for that (fewer than ``SPAN`` runs) have all their runs
as fingerprints, looked up among all runs of a text, chosen or not. The
templates' fingerprints form an inverted index. A hit names a template
and a diagonal; around it, the template is aligned with the text inside a band
of ``BAND`` diagonals to either side. A template is found wherever an alignment
covers at least ``least`` of its words: what lies left and right of a find is
aligned again, so repeated lines are found each. A statement must also bear the
whole name of its license, without ``FILLER`` words and in any order, and no
word or number of another; so must a notice that names its license, and it holds no number that its template
lacks. Licenses whose text holds another's are templates of their own, and of overlapping finds the one with most
matched words stays. ``SPDX-License-Identifier`` is a template, too: of the expression behind it every known license is found.

The templates are a fixed list, hence broadcast with the task; ``read_templates`` takes whole license texts from files, too. Documents only
pass through. Null and empty texts match nothing; repeated rows are reported each; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import text_column
from starloom.llm.license_texts import BODIES, DISCLAIMERS, NAMES, STATEMENTS

GRAM, SPAN, BAND, LEAST = 3, 3, 6, 0.8
#: Words of names that do not tell licenses apart, and those that other texts use as well.
FILLER, COMMON = frozenset({"license", "version", "universal"}), frozenset(
    {"by", "clause", "general", "public", "no", "attribution", "software", "library"}
)
IDENTIFIER = "SPDX-License-Identifier"
FINDS = "doc_id long, license string, form string, coverage double, matched long, start long, end long"
_WORD = re.compile("[a-z0-9]+")
# What goes on in a name after its last word: a further part of a version.
_MORE_VERSION = re.compile(r"\.0*[1-9]")
# An SPDX expression: identifiers, joined by operators, on one line.
_BEGINS = re.compile(r"[ \t]*:[ \t]*")
_IDENTIFIER = re.compile(r"[ \t(]*([A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)\+?[ \t)]*")
_OPERATOR = re.compile(r"(?:AND|OR|WITH)(?=[ \t(])", re.I)
_SUFFIX = re.compile(r"-(?:only|or-later)$")
_NONE = np.iinfo(np.uint64).max


def lower_ascii(text: str) -> str:
    """Lower case that keeps positions."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def standard_templates() -> list[tuple[str, str, str]]:
    said = [(n, "statement", s.format(name=name)) for n, name in NAMES.items() for s in STATEMENTS]
    said += [("", "identifier", IDENTIFIER)]
    said += [(n, "notice", text) for n, text in BODIES.items()]
    whole = {n: DISCLAIMERS[n.split("-")[0]] for n in BODIES if n.split("-")[0] in DISCLAIMERS}
    return said + [(n, "text", f"{BODIES[n]} {more}") for n, more in whole.items()]


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """The standard templates and whole license texts from files named by their identifiers, such as ``GPL-3.0.txt``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name(), "value").collect()  # a list of licenses
    return standard_templates() + [(unquote(name.rpartition("/")[2]).removesuffix(".txt"), "text", text) for name, text in files]


def identifiers(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """Known licenses of the SPDX expression that begins here, with their places."""
    begins = _BEGINS.match(text, at)
    at = begins.end() if begins else len(text)
    while found := _IDENTIFIER.match(text, at):
        license = KNOWN.get(_SUFFIX.sub("", lower_ascii(found.group(1))))
        if license:
            yield license, found.start(1), found.end(1)
        operator = _OPERATOR.match(text, found.end())
        if not operator:
            return
        at = operator.end()


def name_words(license: str) -> frozenset[str]:
    """The words of a license's name that tell it from others."""
    return frozenset(_WORD.findall(lower_ascii(NAMES.get(license, "")))) - FILLER


KNOWN = {lower_ascii(n): n for n in NAMES}
#: Words that name a license wherever they stand.
NAMING = frozenset(w for n in NAMES for w in name_words(n) if not w.isdigit()) - COMMON


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the rightmost least hash of every ``span`` neighbours (of all, if fewer)."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    span = min(span, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, span)
    least = span - 1 - windows[:, ::-1].argmin(axis=1)
    chosen = np.unique(np.arange(len(windows)) + least)
    return chosen[hashes[chosen] != _NONE]


class Templates:
    def __init__(self, templates: list[tuple[str, str, str]], gram: int = GRAM, span: int = SPAN):
        self.gram, self.span = gram, span
        self.names = [(n, f) for n, f, _ in templates]
        self.words = [_WORD.findall(lower_ascii(t)) for *_, t in templates]
        self.known: dict[str, int] = {}
        for words in self.words:
            for word in words:
                self.known.setdefault(word, len(self.known) + 1)
        self.numbers = [np.array([self.known[w] for w in words], dtype=np.int64) for words in self.words]
        # Of templates with fewer runs than a text is winnowed by, every run counts: none needs to be chosen there.
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate(self.numbers):
            hashes = self.hashes(words)
            few = len(hashes) < span
            index = self.short if few else self.index
            for at in range(len(hashes)) if few else winnow(hashes, span).tolist():
                index.setdefault(int(hashes[at]), []).append((number, at))
        self.prints = np.array(sorted(self.index), dtype=np.uint64)
        self.short_prints = np.array(sorted(self.short), dtype=np.uint64)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """One hash per run of words; runs with a word that no template has come last in any order."""
        count = len(words) - self.gram + 1
        if count < 1:
            return np.empty(0, dtype=np.uint64)
        code, known = np.zeros(count, dtype=np.uint64), np.ones(count, dtype=bool)
        with np.errstate(over="ignore"):
            for k in range(self.gram):
                part = words[k : k + count]
                code = (code + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
                known &= part > 0
        return np.where(known, code, _NONE)

    def find(self, text: str, least: float = LEAST, band: int = BAND) -> list[tuple]:
        """(license, form, coverage, matched, start, end) of a text, in code points."""
        low = lower_ascii(text)
        get = self.known.get
        said = _WORD.findall(low)
        words = np.array([get(w, 0) for w in said], dtype=np.int64)
        hashes = self.hashes(words)
        if not len(hashes) or hashes.min() == _NONE:
            return []
        # Stretches without known runs have no fingerprints: winnow what is left, with its edges.
        places = winnow(hashes, self.span)
        places = places[np.isin(hashes[places], self.prints)]
        every = np.flatnonzero(hashes != _NONE)
        every = every[np.isin(hashes[every], self.short_prints)]
        hits: dict[int, list[tuple[int, int]]] = {}
        for index, chosen in ((self.index, places), (self.short, every)):
            for at in chosen.tolist():
                for number, own in index[int(hashes[at])]:
                    hits.setdefault(number, []).append((at - own, at))
        found = []
        for number, own_hits in hits.items():
            found += [(number, *got) for got in self.stretches(number, words, own_hits, least, band)]
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        found = [f for f in found if self.named(f[0], said[f[2] : f[3] + 1], low, spans[f[3]][1])]
        kept: list[tuple] = []
        taken = np.zeros(len(words), dtype=bool)
        for number, matched, first, last in sorted(found, key=lambda f: (-f[1], len(self.numbers[f[0]]), f[2], f[0])):
            if not taken[first : last + 1].any():
                taken[first : last + 1] = True
                kept.append((number, matched, first, last))
        told: list[tuple] = []
        for n, matched, first, last in sorted(kept, key=lambda k: k[2]):
            start, end = spans[first][0], spans[last][1]
            if self.names[n][1] != "identifier":
                told.append((*self.names[n], matched / len(self.numbers[n]), matched, start, end))
                continue
            for number, (license, begin, stop) in enumerate(identifiers(text, end)):
                count = len(_WORD.findall(low[begin:stop])) + (0 if number else matched)
                told.append((license, "identifier", 1.0, count, begin if number else start, stop))
        return told

    def named(self, number: int, span: list[str], low: str, end: int) -> bool:
        """Whether a stretch bears the name of the license that its template states."""
        license, form = self.names[number]
        if form == "identifier":
            return span == self.words[number]
        own = set(self.words[number])
        name = name_words(license)
        if not name or not name.issubset(own):
            return True
        if any(w in NAMING and w not in name for w in span):
            return False
        start = next((k for k, w in enumerate(span) if w in name), len(span))
        rest = span[start:]
        numbers = name if form == "statement" else own
        if not name.issubset(rest) or any(w.isdigit() and w not in numbers for w in rest):
            return False
        return not (form == "statement" and span[-1].isdigit() and _MORE_VERSION.match(low, end))

    def stretches(
        self, number: int, words: np.ndarray, hits: list[tuple[int, int]], least: float, band: int
    ) -> Iterator[tuple[int, int, int]]:
        """(matched, first, last word) of all alignments of a template that do not overlap; hits are (diagonal, word)."""
        template = self.numbers[number]
        gaps = [(0, len(words), sorted(hits))]
        while gaps:
            start, stop, inside = gaps.pop()
            diagonals = [d for d, _ in inside]
            for low_end, high_end in clusters(diagonals, band):
                near = inside[bisect_left(diagonals, low_end) : bisect_right(diagonals, high_end)]
                # The stretch of text that the band can reach.
                begin = max(start, low_end - band)
                end = min(stop, high_end + band + len(template))
                got = alignments(template, words, low_end - band, high_end + band, least, begin, end)
                if not got:
                    continue
                yield from got
                edges = [begin, *(e for _, first, last in got for e in (first, last + 1)), end]
                between: dict[int, list[tuple[int, int]]] = {}
                for hit in near:
                    side = bisect_right(edges, hit[1]) - 1
                    if side % 2 == 0 and side + 1 < len(edges) and hit[1] + self.gram <= edges[side + 1]:
                        between.setdefault(side, []).append(hit)
                gaps += [(edges[side], edges[side + 1], rest) for side, rest in between.items()]


def clusters(diagonals: list[int], band: int) -> Iterator[tuple[int, int]]:
    """Groups of diagonals no further than a band apart."""
    start = last = diagonals[0]
    for d in diagonals[1:]:
        if d - last > band:
            yield start, last
            start = d
        last = d
    yield start, last


def last_row(template: np.ndarray, words: np.ndarray, low: int, high: int, start: int, stop: int) -> list[tuple]:
    """Per diagonal, the best alignment that ends at or before it: (matched, first word, negated last word).

    Among equal numbers of matches the one that begins last counts, which is the shortest to any end.
    """
    width = high - low + 1
    empty = (0, -1, 1)
    row = [empty] * width
    text = words[start:stop].tolist()
    for j, own in enumerate(template.tolist()):
        new = [empty] * width
        for k in range(width):
            i = j + low + k
            best = row[k]  # (j, i) from (j - 1, i - 1)
            if start <= i < stop and text[i - start] == own:
                best = (best[0] + 1, best[1] if best[0] else i, -i)
            if k + 1 < width and row[k + 1] > best:  # word of the template left out
                best = row[k + 1]
            if k and new[k - 1] > best:  # word of the text left out
                best = new[k - 1]
            new[k] = best
        row = new
    return row


def align(template: np.ndarray, words: np.ndarray, low: int, high: int):
    """Most words of the template matched in order inside the band: (matched, first, last word), or None."""
    got = alignments(template, words, low, high, 0.0, 0, len(words))
    return max(got, key=lambda g: (g[0], g[1] - g[2], g[1])) if got else None


def alignments(
    template: np.ndarray, words: np.ndarray, low: int, high: int, least: float, start: int, stop: int
) -> list[tuple[int, int, int]]:
    """Alignments inside the band and the stretch of words that reach ``least`` and do not overlap, in order of the text.

    Of overlapping ones the one with most matches stays, of equals the shortest. Lesser ones between them may be missing.
    """
    rows = set(last_row(template, words, low, high, start, stop))
    made = [(m, first, -last) for m, first, last in rows if m and m >= least * len(template)]
    kept: list[tuple[int, int, int]] = []
    taken = bytearray(max(0, stop - start))
    for matched, first, last in sorted(made, key=lambda g: (-g[0], g[2] - g[1], -g[1])):
        if not any(taken[first - start : last + 1 - start]):
            taken[first - start : last + 1 - start] = b"\1" * (last + 1 - first)
            kept.append((matched, first, last))
    return sorted(kept, key=lambda g: g[1])


def find_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per find: license, form, coverage (share of the template's words), matched words, span in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(templates or standard_templates())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Templates(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(doc_id, *find) for find in scanner.find(text.as_py(), least)]
            if rows:
                kinds = pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()
                names = ["doc_id", "license", "form", "coverage", "matched", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return slim.mapInArrow(run, FINDS)
