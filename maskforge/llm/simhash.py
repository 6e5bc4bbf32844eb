"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made per text inside an Arrow map.  Distinct fingerprints are dealt by
the pigeonhole rule: two fingerprints at most ``d`` bits apart agree on at least one of
``d + 1`` bit blocks, so each fingerprint goes to ``d + 1`` units (block number, block
value).  A unit sorts its fingerprints by Gray rank and builds a tree over the sorted
run: every node holds the bits that all fingerprints below it share (mask and pattern).
A search walks all fingerprints of a unit down the tree level by level and drops a whole
group as soon as the bits that differ from its shared pattern exceed ``d``.

Units with more than about ``UNIT_ROWS`` fingerprints are cut into chunks and every pair of
chunks becomes its own unit, so no task holds an unbounded group and no link is lost.
A unit returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.llm.common import hex64, ready, shuffle_width, sized_join, staged
from maskforge.llm.components import connected_components

SEED = 42
BITS = 64
#: fingerprints of one unit beyond which it is cut into pairs of chunks
UNIT_ROWS = 4096
#: a unit's size is estimated on one in so many fingerprints
SIZED_ON = 16
#: cut units up to which their table is broadcast
BROADCAST_UNITS = 100_000
FANOUT = 8
#: shingles hashed at once and candidate pairs compared at once (memory, not results)
HASH_STEP = 1 << 15
PAIR_STEP = 1 << 18


# --- fingerprints ---------------------------------------------------------------

def fingerprint(text: bytes | None, words: int) -> int:
    """SimHash of a text's word shingles: a bit is set if over half of the shingle
    hashes (XXH64, repeats counted) have it.  No words, empty or null: 0."""
    if not text:
        return 0
    tokens = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:len(tokens) - words + 1].tolist()
    ends = ends[words - 1:].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), HASH_STEP):
        h = np.array([digest(joined[s:e], SEED)
                      for s, e in zip(starts[at:at + HASH_STEP], ends[at:at + HASH_STEP])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 4) -> DataFrame:
    """``(id, fp BIGINT)`` for every row of ``docs``; only the two columns are read."""
    ready(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch["t"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint")


# --- the index inside one task ----------------------------------------------------

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each bit pattern in the reflected Gray sequence."""
    out = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """Trees over the Gray-sorted fingerprints of several units (one root each)."""

    def __init__(self, unit: np.ndarray, fp: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((gray_rank(fp), unit))
        self.fp = fp[self.order]
        unit = unit[self.order]
        # level 0: the fingerprints; shared mask all ones
        self.mask = [np.full(len(fp), ~np.uint64(0))]
        self.pattern = [self.fp]
        self.first: list[np.ndarray] = []  # per level above: first child
        self.count: list[np.ndarray] = []
        level_unit = unit
        while True:
            start = np.flatnonzero(np.r_[True, level_unit[1:] != level_unit[:-1]])
            run = np.diff(np.r_[start, len(level_unit)])
            if len(run) == len(level_unit) and self.first:
                break
            rank = np.arange(len(level_unit)) - np.repeat(start, run)
            head = np.flatnonzero(rank % fanout == 0)
            mask, pattern = self.mask[-1], self.pattern[-1]
            ones = np.bitwise_and.reduceat(mask & pattern, head)
            zeros = np.bitwise_and.reduceat(mask & ~pattern, head)
            self.first.append(head)
            self.count.append(np.diff(np.r_[head, len(level_unit)]))
            self.mask.append(ones | zeros)
            self.pattern.append(ones)
            level_unit = level_unit[head]
        roots = np.arange(len(level_unit))
        self.root = np.repeat(roots, np.diff(np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]),
                                                   len(unit)]))

    def pairs(self, query: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (sorted positions i < j) of the query positions within their units."""
        at, node = query, self.root[query]
        for level in range(len(self.mask) - 1, -1, -1):
            far = np.bitwise_count((self.fp[at] ^ self.pattern[level][node]) & self.mask[level][node])
            keep = far <= distance
            at, node = at[keep], node[keep]
            if level:
                n = self.count[level - 1][node]
                base = np.repeat(self.first[level - 1][node] - np.r_[0, np.cumsum(n)[:-1]], n)
                at, node = np.repeat(at, n), base + np.arange(n.sum())
        keep = at < node
        return at[keep], node[keep]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the pairs (a, b); ``label`` holds each item's root."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def unit_links(unit: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links at most ``distance`` bits apart inside each unit."""
    if not len(fp):
        return fp, fp
    index = GrayIndex(unit, fp)
    size = np.bincount(index.root)[index.root]
    label = np.arange(len(fp))
    work = np.cumsum(size)
    at = 0
    while at < len(fp):
        base = work[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(work, base + PAIR_STEP, side="right")))
        _union(label, *index.pairs(np.arange(at, to), distance))
        at = to
    far = np.flatnonzero(label != np.arange(len(fp)))
    return index.fp[far], index.fp[label[far]]


# --- distributed linking ----------------------------------------------------------

def blocks(distance: int, agree: int = 1) -> list[tuple[int, int]]:
    """(shift, width) of ``distance + agree`` bit blocks that tile 64 bits."""
    n = distance + agree
    edge = [BITS * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edge, edge[1:])]


def links(nodes: DataFrame, distance: int, unit_rows: int = UNIT_ROWS, agree: int = 1) -> DataFrame:
    """``nodes(fp)`` distinct -> edges ``(u, v)`` that span every class of fingerprints
    linked at ``distance`` or fewer bits.

    With ``agree`` > 1, bits are cut into ``distance + agree`` blocks and a unit shares that
    many of them: more copies of each fingerprint, but far smaller units.
    """
    masks = [sum(((1 << w) - 1) << lo for lo, w in chosen)
             for chosen in itertools.combinations(blocks(distance, agree), agree)]
    key = F.array(*[F.struct(F.lit(k).alias("b"), F.col("fp").bitwiseAND(
        m - (1 << 64) if m >> 63 else m).alias("x")) for k, m in enumerate(masks)])
    dealt = nodes.select("fp", F.explode(key).alias("k")).select("fp", "k.b", "k.x")
    return dealt_links(dealt, distance, unit_rows)


def dealt_links(dealt: DataFrame, distance: int, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``dealt(fp, b, x)`` -> edges ``(u, v)`` that span the fingerprints at most ``distance``
    bits apart among those that share a unit ``(b, x)``."""
    spark = ready(dealt)
    # units are sized on a 16th of the fingerprints, drawn by hash: one that is several times
    # too large is seen for sure, and a unit that is cut needlessly loses no link
    drawn = dealt.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(SIZED_ON)) == 0)
    large = (drawn.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") * SIZED_ON > unit_rows)
             .select("b", "x", F.ceil(F.col("n") * SIZED_ON / unit_rows).cast("int").alias("c")))
    dealt = sized_join(dealt, staged(large, "simhash-large"), ["b", "x"], "left", BROADCAST_UNITS)
    chunk = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    dealt = dealt.withColumn("i", F.when(F.col("c").isNotNull(), chunk).otherwise(0))
    other = F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != F.col("i")))
    dealt = dealt.withColumn("j", F.explode(other)).select(
        "fp", F.xxhash64("b", "x", F.least("i", "j"), F.greatest("i", "j")).alias("unit"))
    dealt = dealt.repartition(shuffle_width(spark), "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_u, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(u, f):
            next_same = np.r_[u[1:] == u[:-1], False]
            shared = next_same | np.r_[False, next_same[:-1]]  # most units hold one fingerprint
            a, b = unit_links(u[shared], f[shared], distance)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        for batch in batches:
            kept_u = np.r_[kept_u, batch["unit"].to_numpy()]
            kept_f = np.r_[kept_f, batch["fp"].to_numpy().view(np.uint64)]
            # the last unit may go on in the next batch
            whole = int(np.searchsorted(kept_u, kept_u[-1])) if len(kept_u) else 0
            if whole >= 1 << 15:
                yield edges(kept_u[:whole], kept_f[:whole])
                kept_u, kept_f = kept_u[whole:], kept_f[whole:]
        if len(kept_u):
            yield edges(kept_u, kept_f)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """Class of every document under the relation "fingerprints differ in at most
    ``max_distance`` bits", closed transitively.

    Returns ``(<id_col>, fp BIGINT, fingerprint STRING, component_id)``, one row per input
    row; ``component_id`` is the smallest id of the class.  Null and empty texts have
    fingerprint 0 and are linked like any other; a null id keeps its row and never becomes
    a component id unless the class has no other; repeated rows and ids keep their rows;
    an empty table gives an empty result; other columns are never read.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_distance))
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(low, "root").select("fp", "component_id")
    return fps.join(of, "fp").select(F.col("id").alias(id_col), "fp",
                                     hex64(F.col("fp")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id.

    All columns pass through unchanged.  Rows that repeat an id are one document and keep
    one row.  Rows with a null id cannot stand for a class; they stay only where the class
    has no other id.
    """
    found = simhash_components(docs, id_col, text_col, shingle_words, max_distance)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("__h"), F.col(id_col).alias("__id")).distinct()
    out = docs.withColumn("__h", F.coalesce(F.xxhash64(id_col), F.lit(0)))
    out = out.join(kept, (out["__h"] == kept["__h"]) & out[id_col].eqNullSafe(kept["__id"]), "left_semi")
    return out.dropDuplicates(["__h", id_col]).drop("__h")
