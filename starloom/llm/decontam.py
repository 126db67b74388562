"""Benchmark decontamination by q-gram counts in diagonal bands.

A document is contaminated by a benchmark item if some region of it is within
``floor(rate * length)`` edits of the whole item. Letters are compared in lower
case and any white space as a space. By the q-gram lemma such a region shares
at least ``m + 1 - q - q * e`` q-grams with the item (m characters, e edits),
all on at most ``2 e + 1`` neighbouring diagonals. So:

1. look every q-gram of the document up in a table of the items' q-grams;
2. count hits by item and band of diagonals, bands overlapping by half;
3. keep the bands that meet the bound for the item;
4. align the item with the region of the band (edit distance inside the band,
   free ends in the document) and report what is within the budget; costs
   alone first, for many bands at once, then spans where they suffice.

Documents only pass through; nothing is shuffled. The items are broadcast in
blocks of at most about ``BLOCK_CHARS`` characters, whatever their number, and
every block meets all documents.

Null and empty texts, documents and items alike, match nothing. Items shorter
than ``MIN_CHARS`` have no edits to spend and count only where they stand as a
whole. Repeated items are reported under each id, repeated rows of documents each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import repeat_ranges, text_column

Q, RATE, MIN_CHARS = 8, 0.1, 40
BLOCK_CHARS = 1_000_000
#: Characters of documents scanned at a time.
SCAN_CHARS = 1_000_000
HITS = "doc_id long, item_id long, start long, end long, edits long"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 22
_GAP = 0x110000  # no character
#: Hits of q-grams on items expanded, and cells of alignments computed, at a time.
POSTINGS_AT_ONCE, CELLS_AT_ONCE = 2_000_000, 150_000


def folded(text: str) -> str:
    """Lower case and plain spaces, position by position."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def code_points(text: str) -> np.ndarray:
    points = np.frombuffer(folded(text).encode("utf-32-le"), dtype=np.uint32)
    space = (points <= 32) | (points == 0xA0)
    return np.where(space, np.uint32(32), points)


def gram_codes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the q-gram at each position, by doubling."""
    if len(points) < q:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, width = points.astype(np.uint64) * _MIX, 1
        power ^= power >> np.uint64(29)
        out, done = None, 0
        factor = _BASE
        while True:
            if q & width:
                if out is None:
                    out, done = power, width
                else:
                    n = min(len(out), len(power) - done)
                    out = out[:n] * factor + power[done : done + n]
                    done += width
            if done == q:
                return out[: len(points) - q + 1]
            n = len(power) - width
            power = power[:n] * factor + power[width:]
            width *= 2
            factor = factor * factor


def budget(length: int, rate: float) -> int:
    return int(length * rate + 1e-9) if length >= MIN_CHARS else 0


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, limit: int):
    """Best alignment of the whole item inside the region: (edits, start, end), or None.

    Only cells with ``low <= region position - item position <= high`` count;
    beginning and end in the region are free.
    """
    width = high - low + 1
    far = limit + 1
    band = np.arange(width)
    at = band + low  # region position before the first item character
    cost = np.where((at >= 0) & (at <= len(region)), 0, far)
    begin = at.copy()
    padded = np.concatenate((np.full(max(0, -low), _GAP, np.uint32), region, np.full(len(item) + width + 1, _GAP, np.uint32)))
    shift = max(0, -low)
    for j, character in enumerate(item.tolist()):
        # Cell (j + 1, i + 1) from (j, i); i = j + low + k.
        window = padded[j + low + shift : j + low + shift + width]
        step = cost + (window != character)
        come = begin
        # Item character left out: (j, i) -> (j + 1, i) moves one band to the left.
        skip = np.append(cost[1:] + 1, far)
        better = skip < step
        step = np.where(better, skip, step)
        come = np.where(better, np.append(begin[1:], 0), come)
        # Region character left out: moves right along the band; running minimum.
        slope = step - band
        best = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == best, band, 0))
        cost = np.minimum(best + band, far)
        begin = come[source]
        inside = (j + 1 + low + band >= 0) & (j + 1 + low + band <= len(region))
        cost = np.where(inside, cost, far)
        if cost.min() > limit:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(begin[k]), len(item) + low + k


def whole(item: np.ndarray, region: np.ndarray):
    """The alignment without edits, found as a plain substring."""
    needle, hay = item.tobytes(), region.tobytes()
    at = hay.find(needle)
    while at % 4 and at >= 0:
        at = hay.find(needle, at + 1)
    return None if at < 0 else (0, at // 4, at // 4 + len(item))


@dataclass
class ItemIndex:
    """The q-grams of a block of items that share one q."""

    q: int
    ids: np.ndarray
    points: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    table: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    post_item: np.ndarray
    post_at: np.ndarray
    #: More than any item's length: shifts diagonals above zero.
    shift: int
    #: Whether the q-grams of an item's second half stand in fewer items than those of its first.
    rare_end: np.ndarray


def gram_size(length: int, rate: float) -> int:
    """The largest q up to Q that leaves the lemma a bound of at least a quarter of the item."""
    e = budget(length, rate)
    if not e:
        return min(Q, length)
    return max(1, min(Q, (length + 1 - max(1, length // 8)) // (e + 1)))


def build_indexes(items: list[tuple[int, str]], rate: float) -> list[ItemIndex]:
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item_id, text in items:
        points = code_points(text.strip()) if text else np.empty(0, np.uint32)
        if len(points):
            groups.setdefault(gram_size(len(points), rate), []).append((item_id, points))
    out = []
    for q, members in sorted(groups.items()):
        codes = [gram_codes(p, q) for _, p in members]
        counts = np.array([len(c) for c in codes])
        every = np.concatenate(codes)
        item = np.repeat(np.arange(len(members)), counts)
        at = repeat_ranges(np.zeros(len(members), dtype=np.int64), counts)
        order = np.argsort(every, kind="stable")
        unique, first, number = np.unique(every[order], return_index=True, return_counts=True)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[slots(unique)] = True
        lengths = np.array([len(p) for _, p in members])
        edits = np.array([budget(n, rate) for n in lengths])
        need = np.maximum(1, lengths + 1 - q - q * edits)
        shared = number[np.searchsorted(unique, every)]
        late = at >= np.repeat(counts // 2, counts)
        halves = [np.bincount(item[m], weights=shared[m], minlength=len(members)) for m in (~late, late)]
        out.append(
            ItemIndex(
                q, np.array([-1 if i is None else i for i, _ in members], dtype=np.int64), [p for _, p in members],
                edits, need, table, unique, first, number, item[order].astype(np.int64), at[order],
                int(lengths.max()) + 1, halves[1] < halves[0],
            )
        )
    return out


def slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * _MIX) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def hits_of(index: ItemIndex, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where q-grams of the items stand, and which."""
    codes = gram_codes(points, index.q)
    where = np.flatnonzero(index.table[slots(codes)])
    found = codes[where]
    rank = np.minimum(np.searchsorted(index.codes, found), len(index.codes) - 1)
    true = index.codes[rank] == found
    return where[true], rank[true]


def bands_of(index: ItemIndex, where: np.ndarray, rank: np.ndarray, size: int, distinct: bool) -> tuple[np.ndarray, np.ndarray]:
    count = index.count[rank]
    post = repeat_ranges(index.first[rank], count)
    item = index.post_item[post]
    diagonal = np.repeat(where, count) - index.post_at[post]
    width = 2 * index.edits[item] + 1
    stretch = np.int64(size + 2 * index.shift)
    key = item * stretch + (diagonal + index.shift) // width
    if distinct:
        at = index.post_at[post]
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        key = key[np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))]
    key, hits = np.unique(key, return_counts=True)
    near = np.searchsorted(key, key + 1)
    near_hits = np.where((near < len(key)) & (key[np.minimum(near, len(key) - 1)] == key + 1), hits[np.minimum(near, len(key) - 1)], 0)
    item = key // stretch
    passed = hits + near_hits >= index.need[item]
    return item[passed], (key % stretch)[passed]


def bands(index: ItemIndex, points: np.ndarray, distinct: bool = False, at_once: int = POSTINGS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Item and number of each band that meets the bound; band b of an item covers
    the diagonals from b * w to (b + 2) * w - 1 with w = 2 e + 1. ``distinct``
    counts a q-gram of the item once per half band, however often it is hit.

    Hits are expanded to items in portions of the text that overlap by more than a band
    reaches, so every band is counted whole in one of them.
    """
    none = np.empty(0, dtype=np.int64)
    where, rank = hits_of(index, points)
    if not len(where):
        return none, none
    work = np.cumsum(index.count[rank])
    if work[-1] <= at_once:
        return bands_of(index, where, rank, len(points), distinct)
    reach = index.shift + 4 * int(index.edits.max()) + 2 + index.q
    parts, at = [], 0
    while True:
        end = int(np.searchsorted(work, (work[at - 1] if at else 0) + at_once, "right"))
        end = max(end, int(np.searchsorted(where, where[at] + 2 * reach)))
        parts.append(bands_of(index, where[at:end], rank[at:end], len(points), distinct))
        if end >= len(where):
            break
        at = max(at + 1, int(np.searchsorted(where, where[end] - reach)))
    both = np.unique(np.stack([np.concatenate([p[k] for p in parts]) for k in (0, 1)]), axis=1)
    return both[0], both[1]


def within_budget(index: ItemIndex, points: np.ndarray, items: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which bands may hold their item within its edits: the alignment's costs, for many bands at once.

    An item is read from the end whose q-grams fewer items share, so bands that have only
    a common beginning in them are given up after a few letters.
    """
    out = np.ones(len(items), dtype=bool)
    for e in np.unique(index.edits[items]).tolist():
        if not e:
            continue
        width = 2 * (2 * e + 1) + 2 * e
        for backwards in (False, True):
            some = np.flatnonzero((index.edits[items] == e) & (index.rare_end[items] == backwards))
            some = some[np.argsort([len(index.points[k]) for k in items[some]], kind="stable")]
            chunk = max(1, CELLS_AT_ONCE // width)
            for low in range(0, len(some), chunk):
                part = some[low : low + chunk]
                first = band[part] * (2 * e + 1) - index.shift - e
                texts = [index.points[k] for k in items[part]]
                if backwards:
                    first = len(points) - np.array([len(t) for t in texts]) - (first + width - 1)
                    out[part] = banded_costs([t[::-1] for t in texts], points[::-1], first, width, e)
                else:
                    out[part] = banded_costs(texts, points, first, width, e)
    return out


def banded_costs(items: list[np.ndarray], points: np.ndarray, first: np.ndarray, width: int, limit: int) -> np.ndarray:
    """Whether each item, aligned on diagonals ``first`` to ``first + width - 1``, can cost at most ``limit``.

    What lies beyond the text costs an edit a letter, as leaving the item's letter out does.
    """
    lengths = np.array([len(t) for t in items])
    longest = int(lengths.max())
    letters = np.full((longest, len(items)), _GAP + 1, dtype=np.uint32)
    for k, t in enumerate(items):
        letters[: len(t), k] = t
    before = max(0, -int(first.min()))
    after = max(0, int(first.max()) + longest + width - len(points))
    padded = np.concatenate((np.full(before, _GAP, np.uint32), points, np.full(after, _GAP, np.uint32)))
    place = (first + before)[:, None] + np.arange(width)
    slope = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(items), width), dtype=np.int32)
    alive, passed = np.arange(len(items)), np.zeros(len(items), dtype=bool)
    for j in range(longest):
        step = cost + (padded[place + j] != letters[j, alive][:, None])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
        over = lengths[alive] == j + 1
        if over.any() or j % 4 == 3:
            least = cost.min(axis=1) <= limit
            passed[alive[over & least]] = True
            stay = least & ~over
            if not stay.all():
                cost, place, alive = cost[stay], place[stay], alive[stay]
                if not len(alive):
                    break
    return passed


def verified(index: ItemIndex, points: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of all regions within the budget, overlapping ones of an item merged."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    items, numbers = bands(index, points, distinct=True)
    may = within_budget(index, points, items, numbers)
    for k, band in zip(items[may].tolist(), numbers[may].tolist()):
        item, e = index.points[k], int(index.edits[k])
        width = 2 * e + 1
        low = band * width - index.shift - e
        high = low + 2 * width - 1 + 2 * e
        base = max(0, low)
        if any(cost == 0 and low <= begin <= high for begin, _, cost in out.get(k, ())):
            continue  # its diagonal lies in this band, too
        region = points[base : max(0, high + len(item))]
        got = whole(item, region) or banded_distance(item, region, low - base, high - base, e)
        if got is not None:
            out.setdefault(k, []).append((got[1] + base, got[2] + base, got[0]))
    result = []
    for k, spans in out.items():
        kept: list[tuple[int, int, int]] = []
        for span in sorted(spans, key=lambda s: (s[2], s[0])):
            if all(span[1] <= a or span[0] >= b for a, b, _ in kept):
                kept.append(span)
        result += [(k, *s) for s in sorted(kept)]
    return result


def scan_block(texts: list[str], indexes: list[ItemIndex]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, start, end, edits) for a run of texts scanned together."""
    gap = np.array([_GAP], dtype=np.uint32)
    parts = [code_points(t) for t in texts]
    starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
    joined = np.concatenate([x for p in parts for x in (p, gap)])
    out = []
    for index in indexes:
        item, band = bands(index, joined)
        if not len(item):
            continue
        width = 2 * index.edits[item] + 1
        low = band * width - index.shift - index.edits[item]
        high = low + 2 * width + 2 * index.edits[item] + np.array([len(p) for p in index.points])[item]
        first = np.searchsorted(starts, np.maximum(low, 0), side="right") - 1
        last = np.searchsorted(starts, np.maximum(high, 0), side="right") - 1
        texts_hit = np.unique(repeat_ranges(first, last - first + 1))
        for n in texts_hit[(texts_hit >= 0) & (texts_hit < len(texts))].tolist():
            for k, start, end, edits in verified(index, parts[n]):
                out.append((n, int(index.ids[k]), start, end, edits))
    return out


def benchmark_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks by a hash of the text; each block is small enough to broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for number in range(count):
        yield [(r[0], r[1]) for r in items.filter(block == number).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document, item and region (code points, end exclusive) with the edits needed."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    found = None
    for items in benchmark_blocks(benchmark, block_chars):
        one = _scan(slim, items, rate)
        found = one if found is None else found.unionByName(one)
    return found


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    rows, texts, held = [], [], 0
    for number, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
        value = text.as_py() or ""
        rows.append(number)
        texts.append(value)
        held += len(value)
        if held >= SCAN_CHARS:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def _scan(slim: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = build_indexes(shared.value, rate)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, texts in _pieces(batch):
                hits = scan_block(texts, indexes)
                if hits:
                    columns = [[ids[rows[h[0]]] for h in hits], *([h[k] for h in hits] for k in range(1, 5))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"]
                    )

    return slim.mapInArrow(run, HITS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of documents without any contaminated region; columns stay as they are."""
    for items in benchmark_blocks(benchmark, block_chars):
        docs = _clean(docs, items, rate)
    return docs


def _clean(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = build_indexes(shared.value, rate)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for rows, texts in _pieces(batch):
                for hit in scan_block(texts, indexes):
                    keep[rows[hit[0]]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
