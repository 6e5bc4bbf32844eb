"""Removal of long repeated byte strings with run-compressed Burrows-Wheeler indexes.

Co-location.  Every string of ``length`` bytes has an anchor: the ``GRAM``-byte string of least
hash in it.  Equal strings have equal anchors at equal offsets, so the strings of a text are
dealt by anchor: a run of neighbouring string starts with one anchor is a segment, which
belongs to exactly one anchor group, and every string lies in exactly one segment.
Segments whose whole bytes occur at several places are counted by hash first; only groups
with differing segments, some of them single, go to an index, each distinct segment once.

Index.  A task concatenates the segments of its groups, sorts their suffixes, and keeps the
runs of the Burrows-Wheeler transform with the text position of each run's first and last
row (the sampled run ends).  Inside a run a suffix's longest match with its neighbour is one
less than that of the suffix before it in the text, so matches are computed at run ends only
and the matching statistics of all positions stream from there in text order.  Positions
that match ``length`` bytes elsewhere mark them.

Groups with more than ``GROUP_SEGMENTS`` distinct segments are cut into chunks and every pair
of chunks gets its own index, so tasks are bounded and no match is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from maskforge.llm.common import RangeHash, buffer_of, ready, shuffle_width, slices, staged

LENGTH = 400
GRAM = 64
GROUP_SEGMENTS = 1024
#: index text a task gathers before it builds an index (a larger single group is taken whole)
INDEX_BYTES = 1 << 17
#: text cut into segments at once; some twenty arrays hold eight bytes for each of these
PART_BYTES = 1 << 18
#: bits of the fixed-size key filter that spares texts without work a shuffle
FILTER_BITS = 1 << 23


# --- segments of a text -------------------------------------------------------------

def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbouring values."""
    blocks = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(v)] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - w + 1
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start in text, bytes, anchor hash, bytes hash)`` of every segment."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    of = RangeHash(data)
    at = np.arange(n - gram + 1)
    h = of(at, at + gram)
    place = max(1, int(n).bit_length())
    # the hash's upper bits, then the place: ties go to the first
    best = _window_min((h >> np.uint64(place) << np.uint64(place)) | at.astype(np.uint64), length - gram + 1)
    anchor = (best & np.uint64((1 << place) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(offsets, start, side="right") - 1
    whole = start + length <= offsets[text + 1]
    start, anchor, text = start[whole], anchor[whole], text[whole]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first, last = start[head], start[np.r_[head[1:] - 1, len(start) - 1]]
    return (text[head], first - offsets[text[head]], last + length - first, h[anchor[head]],
            of(first, last + length))


# --- the index ------------------------------------------------------------------------

def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array of 9-bit symbols where 0 ends a segment; ``left`` counts the symbols to
    that end.  Suffixes that agree up to their end are ordered by place, as if every end
    were a symbol of its own."""
    n = len(symbols)
    pad = np.r_[symbols, np.zeros(8, np.uint64)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(left >= k, pad[k:k + n], 0)
    span = 7
    bits = max(1, int(n + 1).bit_length())
    fold = 63 // bits
    most = int(left.max()) + 1 if n else 0
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[1, sorted_key[1:] != sorted_key[:-1]]).astype(np.uint64)
        if int(rank.max()) == n:
            return order
        if span >= most:  # what is still equal is equal up to its end
            return np.argsort((rank << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        key = rank.copy()
        place = np.arange(n)
        for k in range(1, fold):
            to = np.minimum(place + k * span, n - 1)
            key = (key << np.uint64(bits)) | np.where(left >= k * span, rank[to], 0)
        span *= fold


class RunIndex:
    """Runs of the Burrows-Wheeler transform of some segments, with sampled run ends."""

    def __init__(self, parts: list[bytes]):
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size
        n = int(self.end[-1]) + 1
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        symbols = text.astype(np.uint64) + np.uint64(1)
        symbols[self.end] = 0
        left = np.repeat(self.end, size + 1) - np.arange(n)
        order = suffix_order(symbols, left)
        self.left = left
        # what stands before a suffix; before a segment, something unlike anything else
        before = np.r_[np.uint64(0), symbols[:-1]][order].astype(np.int64)
        first = left[order] == np.repeat(size, size + 1)[order]
        before[first] = -1 - np.arange(int(first.sum()))
        change = before[1:] != before[:-1]
        self.run_first = order[np.r_[True, change]]  # sampled ends: text places
        self.run_last = order[np.r_[change, True]]
        self.prev = np.r_[-1, order[:-1]][np.r_[True, change]]
        self.next = np.r_[order[1:], -1][np.r_[change, True]]
        self.hash = RangeHash(text)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at ``a`` and ``b`` within their segments."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.left[a], self.left[b])
        while True:
            wide = low < high
            if not wide.any():
                return low
            mid = (low + high + 1) // 2
            same = self.hash.raw(a, a + mid) == self.hash.raw(b, b + mid)
            low = np.where(wide & same, mid, low)
            high = np.where(wide & ~same, mid - 1, high)

    def _stream(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Match lengths of all positions from those at run ends, in text order."""
        length = np.zeros(len(at), np.int64)
        known = other >= 0
        length[known] = self._common(at[known], other[known])
        order = np.argsort(at)
        at, length = at[order], length[order]
        n = len(self.left)
        last = np.searchsorted(at, np.arange(n), side="right") - 1
        return np.where(last >= 0, length[last] - (np.arange(n) - at[last]), 0)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every position with any other position."""
        return np.maximum(self._stream(self.run_first, self.prev), self._stream(self.run_last, self.next))


def repeated_ranges(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, from, to)``: maximal ranges covered by strings that match elsewhere."""
    index = RunIndex(parts)
    hit = (index.matching_statistics() >= length) & (index.left >= length)
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    segment = np.searchsorted(index.begin, at, side="right") - 1
    head = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + length) | (segment[1:] != segment[:-1])])
    tail = np.r_[head[1:] - 1, len(at) - 1]
    base = index.begin[segment[head]]
    return segment[head], at[head] - base, at[tail] + length - base


# --- distributed flow -------------------------------------------------------------------

def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _filter(keys: DataFrame) -> np.ndarray:
    """Bitmap of fixed size over the keys: no false negatives; it spares shuffles and decides
    nothing else."""
    bit = F.pmod(F.col("key"), F.lit(FILTER_BITS)).cast("int")
    words = (keys.select((bit / 32).cast("int").alias("w"), (bit % 32).alias("n"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, n)")).alias("b")).toPandas())
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return bits


def _may_hold(spark, bits: np.ndarray):
    shared = spark.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes, whatever the input

    @pandas_udf("boolean")
    def test(key):
        import pandas as pd
        b = key.to_numpy() % FILTER_BITS
        return pd.Series((shared.value[b // 32] >> (b % 32).astype(np.uint32)) & 1 == 1)

    return test(F.col("key"))


def _all_segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", PART_BYTES):
                text, start, size, anchor, whole = segments_of(*buffer_of(part["t"]), length, gram)
                yield pa.RecordBatch.from_arrays(
                    [part["key"].take(pa.array(text)), pa.array(start.astype(np.int32)),
                     pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["key", "start", "size", "anchor", "whole"])

    return rows.mapInArrow(run, "key bigint, start int, size int, anchor bigint, whole bigint")


def _index_units(cut: DataFrame, groups: DataFrame, spark) -> DataFrame:
    """Deal distinct segments ``(anchor, whole, bytes)`` into bounded units."""
    large = groups.where(F.col("distinct") > GROUP_SEGMENTS).select(
        "anchor", F.ceil(F.col("distinct") / GROUP_SEGMENTS).cast("int").alias("c"))
    cut = cut.join(large, "anchor", "left")
    i = F.when(F.col("c").isNotNull(), F.pmod(F.col("whole"), F.col("c"))).otherwise(F.lit(0)).cast("int")
    cut = cut.withColumn("i", i)
    other = F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != F.col("i")))
    cut = cut.withColumn("j", F.explode(other)).select(
        F.xxhash64("anchor", F.least("i", "j"), F.greatest("i", "j")).alias("unit"), "anchor", "whole", "bytes")
    return cut.repartition(shuffle_width(spark), "unit").sortWithinPartitions("unit", "anchor", "whole")


def _marked(units: DataFrame, length: int) -> DataFrame:
    """``(anchor, whole, from, to)`` of repeated strings, from the units' indexes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def result(rows):
            segment, lo, hi = repeated_ranges([r[3] for r in rows], length)
            pick = segment.tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[s][1] for s in pick], pa.int64()), pa.array([rows[s][2] for s in pick], pa.int64()),
                 pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["anchor", "whole", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("unit", "anchor", "whole", "bytes"))):
                if size >= INDEX_BYTES and held[-1][0] != row[0]:
                    yield result(held)
                    held, seen, size = [], set(), 0
                # a segment stands once in an index, also where units of a cut group meet
                # or rows repeat an id and a text
                if row[1:3] not in seen:
                    seen.add(row[1:3])
                    held.append(row)
                    size += len(row[3])
        if held:
            yield result(held)

    return units.mapInArrow(run, "anchor bigint, whole bigint, lo int, hi int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """``(key, spans ARRAY<STRUCT<lo, hi>>)``: byte ranges of texts covered by strings of
    ``length`` bytes that start anywhere else too; ``key`` is the hash of id and text."""
    spark = ready(docs)
    rows = docs.select(_key(id_col, text_col).alias("key"), F.col(text_col).alias("t")).where(
        F.octet_length("t") >= length)
    segments = staged(_all_segments(rows, length, gram), "match-segments")
    kinds = segments.groupBy("anchor", "whole").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("key", "start", "size")).alias("at"))
    groups = kinds.groupBy("anchor").agg(F.sum("places").alias("places"), F.count(F.lit(1)).alias("distinct"),
                                         F.min("places").alias("least"))
    groups = groups.where("places > 1")
    kinds = staged(kinds.join(groups.select("anchor", "distinct", "least"), "anchor"), "match-kinds")
    whole = kinds.where("places > 1").select("anchor", "whole", F.lit(0).alias("lo"), F.col("at.size").alias("hi"))
    # groups with differing segments, some of them single: each distinct segment's bytes once
    wanted = kinds.where("distinct > 1 and least = 1").select("anchor", "whole", "distinct", "at.*")
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "whole", "start", "size")).alias("ask"))
    asked = staged(asked, "match-asked")
    holders = rows.where(_may_hold(spark, _filter(asked.select("key"))))
    held = holders.join(asked, "key").select("t", "ask")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, ask in zip(batch["t"], batch["ask"]):
                raw, ask = text.as_py().encode(), ask.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a["anchor"] for a in ask], pa.int64()), pa.array([a["whole"] for a in ask], pa.int64()),
                     pa.array([raw[a["start"]:a["start"] + a["size"]] for a in ask], pa.binary())],
                    ["anchor", "whole", "bytes"])

    cut = held.mapInArrow(cut_out, "anchor bigint, whole bigint, bytes binary")
    sizes = wanted.select("anchor", "distinct").distinct()
    found = _marked(_index_units(cut, sizes, spark), length)
    ranges = found.join(kinds.where("places = 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi")
    ranges = staged(whole.unionByName(ranges), "match-ranges")
    spans = segments.join(ranges, ["anchor", "whole"]).select(
        "key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal ranges of overlapping or touching spans, ascending."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """``(<id_col>, kept BINARY, n_bytes, n_removed, n_spans)`` of every row of ``docs``.

    ``kept`` are the UTF-8 bytes of the text without those covered by a string of ``length``
    bytes that also starts anywhere else.  Null and empty texts and texts shorter than
    ``length`` lose nothing; rows that repeat an id and a text are two places of it; a null
    id is an id; an empty table gives an empty result; other columns are not read.
    """
    spark = ready(docs)
    spans = staged(repeated_spans(docs, id_col, text_col, length, gram), "match-spans")
    rows = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    test = _may_hold(spark, _filter(spans.select("key")))
    rows = rows.withColumn("some", test)
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    both = rows.where("some").join(spans, "key", "left").select("id", "t", "spans")
    both = both.unionByName(rows.where("not some").select("id", "t", none.alias("spans")))
    kind = both.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, runs = [], [], [], []
            for text, spans_of in zip(batch["t"], batch["spans"]):
                raw = (text.as_py() or "").encode()
                cuts = merge(spans_of.as_py() or [])
                at, left = 0, []
                for lo, hi in cuts:
                    left.append(raw[at:lo])
                    at = hi
                left.append(raw[at:])
                kept.append(b"".join(left))
                size.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                runs.append(len(cuts))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, gone, runs))],
                ["id", "kept", "n_bytes", "n_removed", "n_spans"])

    return both.mapInArrow(run, f"id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
                           ).withColumnRenamed("id", id_col)


def oracle(length: int = LENGTH) -> str:
    """DuckDB twin of the digest over ``documents``: all strings, counted by md5."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * length})) AS k
      FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {length - 1})) AS i FROM d WHERE length(h) >= {2 * length})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g
      FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM rep)),
s AS (SELECT r, min(i) AS lo, max(i) + {length} AS hi FROM g GROUP BY r, g),
t AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM s),
x AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed,
  string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
  FROM t JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x USING (r)"""
