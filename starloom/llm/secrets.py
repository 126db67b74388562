"""Secret scan: known forms by pattern, and further ones by a battery of randomness tests.

All of it is column expressions. Patterns give the known forms. Every longer
run of key characters is a candidate: its encoding is inferred (hexadecimal,
base 32, base 36, base 64), its symbols are ranked in that alphabet, and three tests
ask whether it could be random: chi-squared against a uniform alphabet, the
runs test about the middle of the alphabet, and serial correlation. Their
p-values are combined to one per token.

Random tokens have even p-values, others pile up near zero. Within each band of
lengths the number of random tokens is estimated from the upper half of the
p-values, and the lowest acceptance threshold is taken at which the expected share
of non-random tokens among those accepted is at most ``rate``. Short tokens,
for which the tests tell least, so get the strictest thresholds. What is
counted for this is one number per band and bin of p-values, whatever the input.

Null texts count as empty. Rows stay rows: repeated and null ids are kept, extra columns ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, text_column

# Fixed values of the known forms.
KEYWORDS = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
    "[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
ASSIGN = "(" + KEYWORDS + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # a maximal run, as the class is greedy
CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Name, pattern and alphabet, narrowest first. Runs of digits or of letters alone are no encoding.
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Matches whose places are summed up together.
BLOCK = 64
#: Lower ends of the bands of length, bins of p-values, and the share of false finds accepted.
BANDS, BINS, RATE = (16, 20, 24, 32, 48, 96), 200, 0.05


def located(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 1) -> Column:
    """Spans of all matches: start, kind number, end, and the token (the group, if given) of at least ``least`` characters."""
    number = KINDS.index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    token = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    pieces = F.arrays_zip(whole.alias("whole"), token.alias("token"), F.slice(between, 1, F.size(whole)).alias("before"))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT, token: STRING>>)")

    def long(piece: Column) -> Column:
        return F.length(piece["before"]) + F.length(piece["whole"])

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["before"])
        end = start + F.length(piece["whole"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), piece["token"].alias("token"))
        kept = F.when(F.length(piece["token"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    def in_blocks(pieces: Column) -> Column:
        """Growing an array copies it, so places are summed up within blocks and over blocks."""
        count = F.ceil(F.size(pieces) / BLOCK).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
        blocks = F.transform(numbers, lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, walked)

    def walked(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda total, piece: total + long(piece)))
        none = F.expr("CAST(array() AS ARRAY<INT>)")
        begins = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), none.alias("list")),
            lambda state, size: F.struct((state["at"] + size).alias("at"), F.concat(state["list"], F.array(state["at"])).alias("list")),
        )["list"]
        both = F.arrays_zip(blocks.alias("block"), begins.alias("at"))
        return F.flatten(
            F.transform(both, lambda one: F.aggregate(one["block"], F.struct(one["at"].alias("at"), empty.alias("spans")), step)["spans"])
        )

    return F.when(text.rlike(pattern), let(pieces, in_blocks)).otherwise(empty)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and standing in the plan, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def upper_normal(z: Column) -> Column:
    """P(Z > z), by a rational approximation good to seven digits."""

    def tail(t: Column) -> Column:
        return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))

    x = F.abs(z) / math.sqrt(2)
    beyond = let(1 / (1 + 0.3275911 * x), tail) * F.exp(-x * x) / 2
    return let(beyond, lambda q: F.when(z >= 0, q).otherwise(1 - q))


def encoding_of(token: Column) -> Column:
    """Number of the first encoding that fits, or null."""
    out = F.lit(None).cast("int")
    for number, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(pattern), number).otherwise(out)
    return out


def neighbours(values: Column) -> Column:
    """Each value with the one after it."""
    less = F.size(values) - 1
    return F.arrays_zip(F.slice(values, 1, less).alias("a"), F.slice(values, 2, less).alias("b"))


def counted(token: Column, alphabet: Column) -> Column:
    """What the tests need of a token: its ranks in the alphabet, and counts."""
    ranks = F.transform(F.split(token, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    squares = F.aggregate(
        F.split(alphabet, ""),
        F.lit(0.0),
        lambda total, s: total + F.pow((F.length(token) - F.length(F.replace(token, s, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    size = F.length(alphabet).cast("double")
    high = F.transform(ranks, lambda r: (r >= size / 2).cast("int"))
    return F.struct(
        ranks.alias("ranks"),
        F.length(token).cast("double").alias("n"),
        size.alias("size"),
        squares.alias("squares"),
        F.aggregate(high, F.lit(0), lambda a, h: a + h).cast("double").alias("above"),
        let(high, lambda h: F.aggregate(neighbours(h), F.lit(1), lambda c, p: c + F.abs(p["a"] - p["b"]))).cast("double").alias("runs"),
        (F.aggregate(ranks, F.lit(0.0), lambda a, r: a + r) / F.length(token)).alias("mean"),
    )


def chi_squared_z(c: Column) -> Column:
    """Symbol counts against a uniform alphabet, as a normal deviate (Wilson and Hilferty)."""
    free = c["size"] - 1
    spread = 2 / (9 * free)
    value = F.greatest(c["squares"] * c["size"] / c["n"] - c["n"], F.lit(0.0))
    return (F.pow(value / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)


def runs_z(c: Column) -> Column:
    """Number of runs above and below the middle of the alphabet; no z if there is only one side."""
    expected = 2 * c["above"] * (c["n"] - c["above"]) / c["n"] + 1
    variance = (expected - 1) * (expected - 2) / (c["n"] - 1)
    return F.when(variance > 0, (c["runs"] - expected) / F.sqrt(variance)).otherwise(40.0)


def serial_z(c: Column) -> Column:
    """Correlation of neighbouring symbols; no z if all are the same."""
    mean = c["mean"]
    own = F.aggregate(c["ranks"], F.lit(0.0), lambda a, r: a + (r - mean) * (r - mean))
    shared = F.aggregate(neighbours(c["ranks"]), F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
    return let(own, lambda o: F.when(o > 0, (shared / o + 1 / c["n"]) * F.sqrt(c["n"])).otherwise(40.0))


def combined(c: Column) -> Column:
    """P-value of the product of the tests' p-values (Fisher's method): one-sided chi-squared, two-sided others."""
    product = (
        upper_normal(chi_squared_z(c))
        * let(runs_z(c), lambda z: 2 * upper_normal(F.abs(z)))
        * let(serial_z(c), lambda z: 2 * upper_normal(F.abs(z)))
    )
    log = lambda q: F.ln(F.greatest(q, F.lit(1e-300)))
    return let(product, lambda q: q * (1 - log(q) + log(q) * log(q) / 2))


def tested(text: Column) -> Column:
    """Candidates of a text with encoding, length and p-value."""
    spans = F.filter(located(text, CANDIDATE, "random"), lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]"))
    bare = F.transform(
        spans,
        lambda s: let(
            F.rtrim(s["token"], F.lit("=")),
            lambda t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("token"), encoding_of(t).alias("encoding")),
        ),
    )
    alphabets = F.array(*[F.lit(a) for *_, a in ENCODINGS])
    counts = F.transform(
        F.filter(bare, lambda s: s["encoding"].isNotNull()),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["encoding"].alias("encoding"),
            counted(s["token"], F.element_at(alphabets, s["encoding"] + 1)).alias("c"),
        ),
    )
    return F.transform(
        counts,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["encoding"].alias("encoding"),
            s["c"]["n"].alias("n"),
            combined(s["c"]).alias("p"),
        ),
    )


def band_of(n: Column) -> Column:
    out = F.lit(0)
    for number, low in enumerate(BANDS):
        out = F.when(n >= low, number).otherwise(out)
    return out


def thresholds(candidates: DataFrame, rate: float = RATE) -> list[float]:
    """The acceptance threshold of each band, from counts by band and bin (at most ``BANDS * (BINS + 1)`` rows)."""
    counts = (
        candidates.select(F.explode("candidates").alias("c"))
        .select("c.n", "c.p")
        .distinct()  # copies of a token say no more than one
        .groupBy(band_of(F.col("n")).alias("band"), F.floor(F.col("p") * BINS).cast("int").alias("bin"))
        .count()
        .collect()
    )
    out = []
    for band in range(len(BANDS)):
        bins = [0] * BINS
        for row in counts:
            if row["band"] == band:
                bins[min(row["bin"], BINS - 1)] += row["count"]
        random = 2 * sum(bins[BINS // 2 :])  # if p-values are even, half are above one half
        at, accepted = BINS, 0
        for number in range(BINS - 1, 0, -1):  # what falls in the lowest bin is rejected in any case
            accepted += bins[number]
            false = accepted - random * (1 - number / BINS)
            if accepted and false <= rate * accepted:
                at = number
        out.append(min(at / BINS, 0.5))
    return out


def scan(docs: DataFrame, rate: float = RATE, work: Workspace | None = None) -> DataFrame:
    """doc_id, ``base`` and ``found`` (base and random spans): arrays of start, kind number and end, in order."""
    work = work or Workspace(docs.sparkSession, "secrets")
    text = F.col("text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    known = F.concat(
        located(text, ASSIGN, "assign", 2, 8), located(text, ACCESS, "access", None, 16), located(text, HEX, "hex")
    )
    first = work.save(slim.select("doc_id", known.alias("known"), tested(text).alias("candidates")), "candidates")
    limits = thresholds(first, rate)

    def accepted(c: Column) -> Column:
        limit = F.lit(1.0)
        for band, value in enumerate(limits):
            limit = F.when(band_of(c["n"]) == band, F.lit(value)).otherwise(limit)
        return c["p"] >= limit

    def bare(spans: Column, kind: Column | None = None) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), (s["kind"] if kind is None else kind).alias("kind"), s["end"].alias("end")),
        )

    base = bare(F.col("known"))
    random = bare(F.filter("candidates", accepted), F.lit(KINDS.index("random")))
    return first.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, random)).alias("found"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
