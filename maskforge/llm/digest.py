"""Document fingerprints: improbable-feature digests in chained Bloom filters.

Every run of ``WINDOW`` bytes of a text is a candidate feature.  Its entropy falls into one of
``BINS`` bins; the fewer windows of the whole corpus fall into a bin, the better its rank
(``entropy_ranks``; windows of next to no entropy rank last).  A window is selected when it has
the best rank, the leftmost of equals, in at least ``POPULAR`` of the ``REACH`` neighbourhoods of
``REACH`` consecutive windows that hold it.  Selected features, without repeats, go in text order
into Bloom filters of ``FILTER_BITS`` bits, ``FEATURES`` to a filter, five bits each.

Likeness of two digests: for every filter the share of its bits, beyond those met by chance, that
its best partner in the other digest has; the mean over both digests, filters weighted by their
features.  Equal digests have likeness 1, empty digests likeness 1 to each other and 0 to others.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from maskforge.llm.common import RangeHash, buffer_of, ready, shuffle_width, slices

WINDOW = 32
REACH = 32  # at most WINDOW, so that no neighbourhood touches two texts
POPULAR = 8
BINS = 1001
#: bins below this hold windows of next to no entropy: they rank last
TRIVIAL = 100
FILTER_BITS = 2048
FEATURES = 160
HASHES = 5

_UNIT = 1 << 20
_N = np.arange(1, WINDOW + 2)
#: n * log2(n) in 2**-20, and its growth from n - 1 to n
_MASS = np.r_[0, np.rint(_N * np.log2(_N) * _UNIT)].astype(np.int64)
_GROWTH = np.r_[0, np.diff(_MASS)]
_NONE = np.int64(1) << 62


def window_bins(data: np.ndarray) -> np.ndarray:
    """Entropy bin of every run of ``WINDOW`` bytes, from rolling byte counts."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):  # equal bytes among the next and the previous WINDOW - 1
        same = data[k:] == data[:-k]
        ahead[:-k] += same
        behind[k:] += same
    first = _MASS[np.bincount(data[:WINDOW], minlength=256)].sum()
    mass = np.empty(n - WINDOW + 1, np.int64)
    mass[0] = first
    np.cumsum(_GROWTH[behind[WINDOW:].astype(np.int64) + 1] - _GROWTH[ahead[:n - WINDOW].astype(np.int64) + 1],
              out=mass[1:])
    mass[1:] += first
    whole = _MASS[WINDOW]
    return (whole - mass) * (BINS - 1) // whole


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back and their offsets; a text shorter than a window is
    filled up with zero bytes, so it is one window."""
    texts = [t if len(t) >= WINDOW or not t else t.ljust(WINDOW, b"\0") for t in texts]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)] if texts else np.zeros(1, np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie in one text."""
    flag = np.zeros(max(n - WINDOW + 1, 0) + 1, np.int32)
    size = np.diff(offsets)
    has = size >= WINDOW
    np.add.at(flag, offsets[:-1][has], 1)
    np.add.at(flag, offsets[1:][has] - WINDOW + 1, -1)
    return np.cumsum(flag[:-1]) > 0


def selected(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the selected windows of all texts."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(n - WINDOW + 1, dtype=np.int64)
    key = np.where(_inside(offsets, n), (ranks[window_bins(data)] << 32) | at, _NONE)
    edge = np.full(REACH - 1, _NONE)
    best = np.r_[edge, key, edge]
    step = 1
    while step < REACH:  # least key of 1, 2, 4 .. REACH neighbours
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    wins = np.bincount(best[best < _NONE] & 0xFFFFFFFF, minlength=len(at))
    return np.flatnonzero(wins >= POPULAR)


class Digest:
    """Chained filters of one text: ``n`` features and a row of bytes for each filter."""

    def __init__(self, n: int, filters: np.ndarray):
        self.n, self.filters = n, filters
        self.weights = np.bitwise_count(filters).sum(axis=1, dtype=np.int64)
        self.shares = np.full(len(filters), FEATURES)
        if n:
            self.shares[-1] = n - FEATURES * (len(filters) - 1)

    def __str__(self) -> str:
        return f"{self.n}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @staticmethod
    def parse(text: str) -> Digest:
        n, bits = text.split(":")
        return Digest(int(n), np.frombuffer(base64.b64decode(bits), np.uint8).reshape(-1, FILTER_BITS // 8))


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """Digests of a slice of texts."""
    data, offsets = _joined(texts)
    at = selected(data, offsets, ranks)
    hashes = RangeHash(data)(at, at + WINDOW) if len(at) else np.zeros(0, np.uint64)
    text = np.searchsorted(offsets, at, side="right") - 1
    order = np.lexsort((at, hashes, text))  # repeats of a feature in a text: the first stays
    again = np.zeros(len(at), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    hashes, text = hashes[~again], text[~again]
    count = np.bincount(text, minlength=len(texts))
    filters = -(-count // FEATURES)
    base = np.r_[0, np.cumsum(filters)]
    place = np.arange(len(text)) - np.r_[0, np.cumsum(count)][text]
    bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
    width = np.uint64(FILTER_BITS.bit_length() - 1)
    for k in range(HASHES):
        bits[base[text] + place // FEATURES, ((hashes >> (np.uint64(k) * width)) % np.uint64(FILTER_BITS)).astype(int)] = True
    packed = np.packbits(bits, axis=1, bitorder="little")
    return [Digest(int(c), packed[a:b]) for c, a, b in zip(count, base[:-1], base[1:])]


def _contained(a: Digest, b: Digest) -> float:
    """Sum over the filters of ``a`` of their features times the share of bits beyond chance
    that the best filter of ``b`` holds."""
    total = 0.0
    m = FILTER_BITS
    for bits, weight, share in zip(a.filters, a.weights, a.shares):
        both = np.bitwise_count(bits & b.filters).sum(axis=1, dtype=np.int64)
        mean = weight * b.weights / m
        noise = 3 * np.sqrt(mean * (1 - weight / m) * (1 - b.weights / m))
        chance = np.minimum(mean + noise, (mean + weight) / 2)
        total += share * float(np.max(np.clip((both - chance) / np.maximum(weight - chance, 1e-9), 0, 1)))
    return total


def likeness(a: Digest, b: Digest) -> float:
    if a.n == 0 or b.n == 0:
        return float(a.n == b.n)
    if a.n == b.n and np.array_equal(a.filters, b.filters):
        return 1.0
    return (_contained(a, b) + _contained(b, a)) / (a.n + b.n)


# --- tables ----------------------------------------------------------------------------

def entropy_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of every entropy bin, from the windows of all texts: the rarest first, ties by bin,
    bins below ``TRIVIAL`` after all others.  ``BINS`` counts reach the driver."""
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                data, offsets = buffer_of(part["t"])
                total += np.bincount(window_bins(data)[_inside(offsets, len(data))], minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    bins = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "bin int, n bigint")
    count = np.zeros(BINS, np.int64)
    for row in bins.groupBy("bin").agg(F.sum("n").cast("bigint").alias("n")).collect():
        count[row["bin"]] = row["n"]
    order = np.lexsort((np.arange(BINS), count, np.arange(BINS) < TRIVIAL))
    ranks = np.empty(BINS, np.int64)
    ranks[order] = np.arange(BINS)
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with each text's digest as a string in column ``out`` (a column of
    that name is replaced); null texts are empty."""
    ready(docs)
    names = [c for c in docs.columns if c != out]
    docs = docs.select(*names)
    schema = StructType([*docs.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                made = digests([(t or "").encode() for t in part[text_col].to_pylist()], ranks)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([str(d) for d in made])], [*names, out])

    return docs.mapInArrow(run, schema)


def _boundaries(order: DataFrame, n: int) -> list:
    """First ``(id, key)`` of each of at most ``n`` ranges, in order; at most ``n`` rows."""
    first = (order.repartitionByRange(n, "o").groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min("o").alias("o")))
    return sorted((r["o"] for r in first.collect()), key=lambda o: (o["id"] is not None, *([o["id"]] if o["id"] is not None else []), o["key"]))


def _part(bounds: list, kind: str) -> Column:
    """Number of the range that holds ``o``, by binary search over the range starts."""
    starts = F.array(*[F.struct(F.lit(o["id"]).cast(kind).alias("id"), F.lit(o["key"]).cast("bigint").alias("key"))
                       for o in bounds])
    steps = [1 << k for k in reversed(range(max(len(bounds), 1).bit_length()))]

    def jump(at, step):
        to = at + step
        return F.when((to < len(bounds)) & (F.get(starts, to) <= F.col("o")), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), jump)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt so that each range of ids lies in one task in ascending order, followed by the
    first row of the next range (``extra``): columns ``part, extra, id, key, t``.

    The texts are shuffled once.  Ids that several rows share are ordered by a hash of their
    texts; null ids come first; the last range is followed by the very first row.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("key", F.xxhash64("t"))
    kind = rows.schema["id"].dataType.simpleString()
    width = shuffle_width(docs.sparkSession)
    order = F.struct("id", "key")
    bounds = _boundaries(rows.select(order.alias("o")), width)
    part = _part(bounds, kind)
    last = max(len(bounds) - 1, 0)
    rows = rows.withColumn("o", order).withColumn("part", part.cast("int"))
    starts = F.array(*[F.struct(F.lit(o["id"]).cast(kind).alias("id"), F.lit(o["key"]).cast("bigint").alias("key"))
                       for o in bounds])
    is_first = F.get(starts, F.col("part")).eqNullSafe(F.col("o")) if bounds else F.lit(False)
    before = F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1)
    own = F.struct("part", F.lit(False).alias("extra"))
    also = F.struct(before.alias("part"), F.lit(True).alias("extra"))
    dealt = rows.withColumn("to", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))))
    return (dealt.select("to.part", "to.extra", "id", "key", "t").repartitionByRange(width, "part")
            .sortWithinPartitions("part", "extra", "id", "key"))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the next text's beginning."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def edit_study(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` - the digest of its text, of the text edited with the next row's, and their likeness.

    Null and empty texts have an empty digest; an only row is its own next; repeated rows all
    stay; rows are ordered as ``with_next`` says.  An empty table gives no rows.
    """
    ready(docs)
    rows = with_next(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    arrow_fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row before: extra, id (an Arrow scalar), text, digest
        for batch in batches:
            for piece in slices(batch, "t"):
                texts = piece["t"].to_pylist()
                made = digests([t.encode() for t in texts], ranks)
                new = list(zip(piece["extra"].to_pylist(), piece["id"], texts, made))
                line = new if held is None else [held, *new]
                held = line[-1]
                pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[0]]
                if not pairs:
                    continue
                changed = [edited(a[2], b[2]).encode() for a, b in pairs]
                other = digests(changed, ranks)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[1].as_py() for a, _ in pairs], piece["id"].type),
                    pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
                    pa.array([str(a[3]) for a, _ in pairs]), pa.array([str(d) for d in other]),
                    pa.array([likeness(a[3], d) for (a, _), d in zip(pairs, other)]),
                    pa.array([likeness(a[3], b[3]) for a, b in pairs])], arrow_fields)

    return rows.select("part", "extra", "id", "t").mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")
