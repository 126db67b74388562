"""Hard negatives, prefix trie and packing against plain versions, on edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import negatives, packing, trie
from starloom.session import Workspace

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- Packing -------------------------------------------------------------------


def by_rounds(totals, plan):
    """(queue, token) of the whole sequence of tokens, round after round."""
    out, at, deficit = [], [0] * len(totals), [0] * len(totals)
    while any(a < t for a, t in zip(at, totals)):
        for q, total in enumerate(totals):
            deficit[q] += int(plan.credit[q])
            unit = int(plan.quantum[q])
            sent = deficit[q] // (packing.ONE * unit) * unit
            deficit[q] -= sent * packing.ONE
            sent = min(sent, total - at[q])
            out += [(q, at[q] + i) for i in range(sent)]
            at[q] += sent
    return out


@pytest.mark.parametrize("seed", range(40))
def test_schedule_is_the_round_robin(seed):
    rng = random.Random(seed)
    totals = [rng.randint(1, 400) for _ in range(rng.randint(1, 6))]
    weights = totals if seed % 2 else [rng.random() + 0.01 for _ in totals]
    plan = packing.Schedule(totals, weights, rng.choice([16, 32, 64]), rng.choice([1, 3, 8]))
    place = {x: i for i, x in enumerate(by_rounds(totals, plan))}
    docs = []
    for q, total in enumerate(totals):
        at = 0
        while at < total:
            docs.append((q, at, min(total - at, rng.randint(1, 60))))
            at += docs[-1][2]
    rng.shuffle(docs)
    queue, first, count = (np.array(x, dtype=np.int64) for x in zip(*docs))
    seen = set()
    for doc, start, size, sequence, offset in zip(*plan.pieces(queue, first, count)):
        edge = int(plan.edge(np.array([sequence]))[0])
        assert edge + offset + size <= plan.edge(np.array([sequence + 1]))[0]
        for i in range(size):
            token = (int(queue[doc]), int(first[doc] + start + i))
            assert token not in seen and place[token] == edge + offset + i
            seen.add(token)
    assert len(seen) == sum(totals)


def test_windows_hold_the_mixture():
    totals, length = [40_000, 9_000, 900, 100], 500
    plan = packing.Schedule(totals, totals, length, least=20)
    whole = [q for q, _ in by_rounds(totals, plan)]
    for at in range(0, len(whole) - length, length):
        window = whole[at : at + length]
        for q, total in enumerate(totals):
            assert abs(window.count(q) - length * total / sum(totals)) <= 21 * len(totals)


def check_pieces(pieces, docs, end_token=1, length=2048):
    """Pieces cover every id once, sequences are gapless and need no padding."""
    tokenizer = Tokenizer.from_file(WORDS)
    expected = sorted(
        (i if i is not None else -1, zlib.crc32(np.array(ids, dtype="<u4").tobytes()), len(ids))
        for i, ids in ((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_token]) for i, t in docs)
    )
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    sizes = []
    for _, parts in sorted(by_sequence.items()):
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes)))
    assert all(s == length or s & (s - 1) == 0 for s in sizes) and sum(s != length for s in sizes) <= 11
    return expected, by_doc


def texts(rng):
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(9000))
    odd = ["", None, " \n\t", "It's <|endoftext|> we'll ÀÉ ﬁ 12 ...", "é x y İ", "x" * 3000, "same", "same"]
    return [*odd, long, *[" ".join(rng.choice(["To", "be,", "or", "not"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]]


@pytest.mark.parametrize("limits", [(packing.OWN_QUEUES, packing.BROADCAST_ROWS), (2, 0)])
def test_packing(spark, limits):
    rng = random.Random(5)
    docs = [(k, t) for k, t in enumerate(texts(rng))]
    names = ["big", "big", "mid", None, "", *[f"s{k}" for k in range(8)]]
    rows = [(i, t, rng.choice(names), 7, "x") for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, queue string").repartition(5)
    pieces = packing.pack(df, WORDS, own_queues=limits[0], broadcast_rows=limits[1]).collect()
    expected, by_doc = check_pieces(pieces, docs)
    tokenizer = Tokenizer.from_file(WORDS)
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert len(expected) == len(by_doc)


def test_packing_follows_a_given_mixture(spark):
    rows = [(k, "word " * 300, "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, WORDS, length=256, mixture={"a": 3.0, "b": 1.0}).collect()
    share = defaultdict(int)
    for p in pieces:
        if p.sequence_id < 200:  # both sources last that long
            share["ab"[p.doc_id % 2]] += p.length
    assert abs(share["a"] / (share["a"] + share["b"]) - 0.75) < 0.01


def test_packing_repeated_ids_and_empty_table(spark):
    schema = "doc_id long, text string, source string"
    docs = [(1, "a b c"), (1, "a b c"), (None, "d"), (None, None)]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], schema)
    pieces = packing.pack(df, WORDS).collect()
    check_pieces(pieces, docs)
    assert sum(p.length for p in pieces) == 4 + 4 + 2 + 1
    assert packing.pack(spark.createDataFrame([], schema), WORDS).count() == 0


class Counted(dict):
    """Counts what is looked up, and is not to be walked through."""

    found = 0

    def __getitem__(self, key):
        self.found += 1
        return super().__getitem__(key)

    def __iter__(self):
        raise AssertionError("all remembered parts were visited")


def test_word_ids_look_up_a_part_once_per_call():
    ids = packing.WordIds(WORDS)
    ids.known.now, ids.known.before = Counted(), Counted(dog=b"")
    texts = [b"The cat, the CAT; the cat's " * 50] * 40
    expected = np.array(Tokenizer.from_file(WORDS).encode(texts[0].decode(), add_special_tokens=False).ids, dtype="<u4")
    assert ids(texts) == [expected.tobytes()] * 40
    assert ids.known.now.found <= 10  # the, cat, two signs and the ending are five


@pytest.mark.parametrize("kept", [20, packing.PARTS_KEPT])
def test_word_ids_are_those_of_the_library(monkeypatch, kept):
    monkeypatch.setattr(packing, "PARTS_KEPT", kept)
    rng, ids, library = random.Random(3), packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    plain = [*"aabstmdrevl'''\"-.<|> \n\t\x0b019AZÀÖØÞßàöøÿ", "'s", "'re", "'LL", "it's", "x" * 60, " "]
    odd = ["\x00", "\x1c", "\x7f", "\x85", "\xa0", *"×÷µ½’İﬁΣ", "日本", "é", "́", "😀", "<|endoftext|>"]
    for _ in range(150):
        signs = plain if rng.random() < 0.4 else plain + odd
        texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 3, 30, 150]))) for _ in range(rng.randint(0, 12))]
        found = [np.frombuffer(i, dtype="<u4").tolist() for i in ids([t.encode() for t in texts])]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_of_broken_utf8():
    ids, library = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for text in (b"\x80 a", b"a\xc3", b"\xc3 \xa9", b"\xc3\xc3\xa9 b", b"\xff\xc3\x97 C", b"A\xa9 \xc3\x89"):
        found = np.frombuffer(ids([text])[0], dtype="<u4").tolist()
        assert found == library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids


# --- Prefix trie ------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, members in nodes.items():
        value = (len(members) - 1) * len(n[-1][1].encode().split()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += value
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(n))
        parent = min(nodes[n[:-1]]) if n else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(n), parent, len(members), kids[n], leaves[n], saved[n], digest))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, k1 string"


def conversations(rng, kinds=2):
    rows = []
    for c in [*range(0, 90), -1, -20, 5000, 9_999_999]:
        for k in range(rng.choice([0, 1, 2, 3, 5, 9, 40, 41, 70])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", None]), rng.choice([None, "", "a b", "c\x0bd e"][-kinds:])))
    rows += [(200 + k, t, "user", f"t{t}") for k in range(60) for t in range(3)]  # copies
    rows += [(300, t % 7, "user", "same") for t in range(600)]  # long, with ties and repeated rows
    rows += [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height,kinds", [(16, 4), (3, 1), (2, 2)])
def test_trie(spark, monkeypatch, height, kinds):
    rows = conversations(random.Random(height), kinds)
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "IDS_PER_BLOCK", 16)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS).repartition(4)
    got = trie.prefix_trie(df, height=height).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_turnless_and_empty(spark):
    # Conversation 3 takes its first turn from an absent base and has no turn of its own behind it.
    bare = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = trie.prefix_trie(spark.createDataFrame([(bare, 0, "user", "x", 1, "x")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in got] == plain_trie([(bare, 0, "user", "x")]) and got[0].depth == 0
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_one_conversation_is_numbered_by_many_tasks(spark):
    df = spark.createDataFrame([(7, t, "user", f"t{t}", 1, "x") for t in range(5000)], CONVERSATIONS)
    work = Workspace(spark, "numbering")
    rows = trie.numbered_turns(df, work).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(1, 5001))
    assert work.load(trie.NUMBERED, "turns").select("part").distinct().count() > 1


# --- Hard negatives ----------------------------------------------------------------


def plain_negatives(rows, every):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    sound = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(sound):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, k) for k, (j, _, w) in enumerate(sound) if k != a)
        for minus, j, k in [s for s in scored if sound[s[2]][1] == label][:5]:
            best = [(-m, n) for m, n, o in scored if sound[o][1] != label and -30 * minus <= -100 * m <= -90 * minus]
            out += [(i, j, r + 1, n, -minus, s) for r, (s, n) in enumerate(best[:10])]
    return sorted(out)


def vectors(rng, count=300, width=6):
    rows = [(k, rng.randrange(4), [rng.gauss(0, 1) for _ in range(width)]) for k in range(count)]
    rows += [(1000 + k, 1, [0.5] * width) for k in range(40)]  # ties
    rows += [(10, 2, [0.25] * width), (10, 2, [0.25] * width), (20, 9, [0.0] * width)]
    rows += [(31, None, [1.0] * width), (32, 1, None), (33, 1, [None] * width), (None, 1, [1.0] * width)]
    rows += [(34, 1, [float("nan")] * width), (40, 1, [float("inf"), *[1.0] * (width - 1)]), (50, 3, [1.0, -1.0]), (60, 3, []), (61, 2, [2.0] * 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("at_once", [1024, 7])
def test_negatives(spark, at_once):
    rows = vectors(random.Random(at_once))
    schema = "vec_id long, label int, embedding array<float>, row int, rank string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3)
    df = df.withColumn("vector", negatives.whole_vector("embedding", 256))
    as_floats = [(i, lab, v and [x if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    got = negatives.mine_negatives(df, F.col("vec_id") % 10 == 0, anchors_at_once=at_once).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(as_floats, 10) and got


def test_negatives_of_nothing(spark):
    schema = "vec_id long, label int, vector array<double>"
    for rows in ([], [(1, 1, [1.0])], [(100, 1, [1.0])], [(100, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [1.0])]):
        df = spark.createDataFrame(rows, schema)
        assert negatives.mine_negatives(df, F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_pass_over_what_cannot_reach_a_window():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 300
    anchors = np.rint(np.repeat(centres, 16, axis=0) + rng.normal(size=(128, 16)) * 3)
    labels = np.repeat(np.arange(8), 16)
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(128)) and (parent < 0).sum() == 1
    for a in range(128):
        if parent[a] >= 0:
            assert edge[a] == pytest.approx(np.linalg.norm(anchors[a] - anchors[parent[a]]))
            assert list(order).index(parent[a]) < list(order).index(a)
    block = negatives.Block(anchors, labels, np.arange(128), order, parent, edge, [[(400_000.0, 500_000.0)]] * 128, False, 10)
    task = negatives.Search(block)
    candidates = np.rint(centres[rng.integers(0, 8, 500)] + rng.normal(size=(500, 16)) * 20)
    task.feed(np.arange(500), np.full(500, -1), np.arange(1000, 1500), candidates)
    assert task.scored < 0.5 * 128 * 500
    scores = candidates @ anchors.T
    for a in range(128):
        fit = np.flatnonzero((scores[:, a] >= 400_000) & (scores[:, a] <= 500_000))
        best = sorted((-scores[c, a], c) for c in fit)[:10]
        assert [tuple(x[:2]) for x in task.best[a, 0].tolist()] == [(-s, c) for s, c in best]
