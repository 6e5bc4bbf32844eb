"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.session import ship_package, stage_path

#: a word is a run of bytes other than these (0x20 and 0x09-0x0D)
WORD = r"[^\x20\x09-\x0D]+"
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True

#: for comparisons: everything but ASCII letters, digits and non-ASCII characters parts words
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: bytes of text handled at once inside a task; bounds the arrays, never the result
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage is
    cut and lost executors cost only the tasks they were running."""
    path = stage_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: bytes of one Arrow batch; texts vary too much for a bound in rows alone
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(df: DataFrame) -> SparkSession:
    """Session of ``df`` with this package importable in the Python workers and Arrow
    batches of at most ``ARROW_BYTES`` (a smaller setting stays)."""
    spark = df.sparkSession
    ship_package(spark)
    if int(str(spark.conf.get(_ARROW, str(64 << 20))).removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


# --- text buffers inside a task -------------------------------------------------

def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch[text_col]), 0))
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back and each text's offsets (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if texts.null_count == 0 and len(texts):
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] \
            else np.zeros(0, np.uint8)
        return data, off - off[0]
    return np.zeros(0, np.uint8), np.zeros(1, np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = WHITESPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word (run of bytes that are not ``blank``);
    words never cross texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~blank[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = True
    first &= word
    starts = np.flatnonzero(first)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[cut - 1] = True
    last &= word
    ends = np.flatnonzero(last) + 1
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, docs


_MUL = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))
_POW: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the entropy of ``h`` over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class RangeHash:
    """64-bit hashes of arbitrary ranges of one buffer (bytes, or 64-bit values), all at once."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers(_MUL, n)
        np.cumsum(terms, out=self.sums[1:])
        self.inv = _powers(_INV, n + 1)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inv[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64))


def combine(hashes: np.ndarray, n: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words and the index of each window's first word;
    windows never cross texts."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _MUL + hashes[k:k + m]
    at = np.flatnonzero(docs[:m] == docs[n - 1:n - 1 + m])
    return mix(h[at]), at


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as a byte-wise lower-casing does."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit_rows: int) -> DataFrame:
    """Equi-join that broadcasts ``right`` only when it has at most ``limit_rows`` rows
    (counted here) and lets Spark shuffle both sides otherwise; the result is the same."""
    small = right.limit(limit_rows + 1).count() <= limit_rows
    return left.join(F.broadcast(right) if small else right, on, how)
