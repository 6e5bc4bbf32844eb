"""Token-ID output as directly addressable codes.

Documents are range-partitioned by id; every partition writes one file whose rows are
segments of exactly ``SEGMENT`` tokens (the last one may be shorter).  A segment splits
its ids into byte chunks by level: level 0 has the low byte of every id, a continuation
bitmap marks the ids with more bytes, and level 1 has the next byte of those only, and so
on.  A rank directory (set bits before each 512-bit block) turns a position on one level
into the position on the next, so any token is read by a few array look-ups without
decoding its neighbours.

Segment row: ``part, seq, first`` (tokens before it in the part), ``n_tokens``, the document
table ``ord, doc_id, piece, doc_tokens`` (arrays, one entry per document that touches the
segment) and the levels ``chunks, bitmaps, ranks`` (arrays of binary).
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskforge.llm.common import RangeHash, buffer_of, ready, shuffle_width, slices

SEGMENT = 1 << 16
RANK_BITS = 512
#: distinct text pieces a worker remembers (memory, not results)
CACHED_PIECES = 2_000_000


# --- directly addressable codes ---------------------------------------------------

def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Byte chunks, continuation bitmaps and rank directories by level."""
    chunks, bitmaps, ranks = [], [], []
    left = ids.astype(np.uint32)
    while True:
        more = left > 0xFF
        chunks.append((left & 0xFF).astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(more).tobytes())
        per = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else more
        ranks.append((np.cumsum(per) - per).astype("<u4").tobytes())
        if not more.any():
            return chunks, bitmaps, ranks
        left = left[more] >> np.uint32(8)


def dac_decode(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment, from the highest level down."""
    above = None
    for chunk, bitmap in zip(reversed(chunks), reversed(bitmaps)):
        ids = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        if above is not None:
            more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(ids)).astype(bool)
            ids[more] |= above << np.uint32(8)
        above = ids
    return above


def dac_get(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes],
            at: np.ndarray) -> np.ndarray:
    """Ids at positions ``at`` by rank look-ups alone."""
    out = np.zeros(len(at), np.uint32)
    live = np.arange(len(at))
    pos = np.asarray(at, np.int64)
    for level, (chunk, bitmap, rank) in enumerate(zip(chunks, bitmaps, ranks)):
        out[live] |= np.frombuffer(chunk, np.uint8)[pos].astype(np.uint32) << np.uint32(8 * level)
        if level + 1 == len(chunks):
            break
        raw = np.frombuffer(bitmap, np.uint8)
        more = (raw[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1 == 1
        live, pos = live[more], pos[more]
        # rank: the block's directory entry, whole bytes of the block, bits of the last byte
        block = pos // RANK_BITS
        byte0, byte1 = block * (RANK_BITS // 8), pos >> 3
        ones = np.r_[0, np.cumsum(np.bitwise_count(raw), dtype=np.int64)]
        head = raw[byte1] >> (8 - (pos & 7)).astype(np.uint8)
        pos = (np.frombuffer(rank, "<u4")[block].astype(np.int64) + ones[byte1] - ones[byte0]
               + np.bitwise_count(np.where(pos & 7, head, 0).astype(np.uint8)))
    return out


# --- encoding ---------------------------------------------------------------------

def tokenizer_file(tokenizer: str) -> str:
    """A path as it is; else a file of the installed public tokenizers."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: first bytes that may begin, and last bytes that may end, a blank character
_MAY_START_BLANK = _bytes_in((9, 13), (0x1C, 0x20), (0xC2, 0xC2), (0xE1, 0xE3))
_MAY_END_BLANK = _bytes_in((9, 13), (0x1C, 0x20), (0x80, 0xBF))
_NO_BLANK = _bytes_in((0x21, 0x7E))
_ALNUM = _bytes_in((48, 57), (65, 90), (97, 122))
_POINT = np.zeros(256, bool)
_POINT[list(b".,;:!?")] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a byte-level pre-tokenizer surely begins a new pre-token.

    Before a space, unless blanks may stand on both sides of it (the pre-tokenizer joins a
    run of blanks but for its last space); before a point that follows a letter or digit;
    before a line feed after a non-blank, and after it if a non-blank follows.
    """
    n = len(data)
    prev = np.r_[np.uint8(32), data[:-1]]
    after = np.r_[data[1:], np.uint8(32)]
    inner = offsets[(offsets > 0) & (offsets < n)]
    after[inner - 1] = 32  # the end of a text counts as a blank
    prev2 = np.r_[np.uint8(32), prev[:-1]]
    letter = _ALNUM[prev] | ((prev2 == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7))
    cut = (data == 32) & ~(_MAY_END_BLANK[prev] & _MAY_START_BLANK[after])
    cut |= _POINT[data] & letter
    feed = data == 10
    cut |= feed & _NO_BLANK[prev]
    cut |= (prev == 10) & _NO_BLANK[prev2] & ~_MAY_START_BLANK[data] & (data != 0xC2)
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` for many texts at once.

    Texts are cut where the byte-level pre-tokenizer surely cuts (:func:`piece_starts`);
    each distinct piece is encoded by the library once and remembered under its 64-bit
    hash.  Texts that contain an added token, and other kinds of tokenizer, are encoded
    whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space") and made.get("normalizer") is None
                     and not (made.get("model") or {}).get("dropout"))
        self.added = [t["content"].encode() for t in made.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)   # sorted hashes of known pieces
        self.at = np.zeros(0, np.int64)      # their ids' place in ``pool``
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(size.sum())), size

    def _learn(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, size = self._encode([raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())])
        at = len(self.pool) + np.cumsum(size) - size
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(old, where, new) for old, new in (
            (self.keys, keys), (self.at, at), (self.size, size)))
        self.pool = np.r_[self.pool, ids]

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return where, self.keys[where] == keys

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and how many each text has (null: none)."""
        n = len(texts)
        data, offsets = buffer_of(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw = data.tobytes()
        if not self.cuts or any(raw.find(t) >= 0 for t in self.added):
            return self._encode([raw[s:e].decode() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        starts = piece_starts(data, offsets)
        ends = np.r_[starts[1:], len(data)]
        keys, first, back = np.unique(RangeHash(data)(starts, ends), return_index=True, return_inverse=True)
        where, known = self._lookup(keys)
        if not known.all():
            if len(self.keys) + len(keys) > CACHED_PIECES:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            self._learn(raw, keys[new], starts[first[new]], ends[first[new]])
            where, _ = self._lookup(keys)
        size = self.size[where][back]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[where][back] - (total - size), size) + np.arange(total[-1])]
        upto = np.r_[0, total][np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(tokenizer: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    path = tokenizer_file(tokenizer)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _segment_schema(kind: str) -> str:
    return (f"part int, seq int, first bigint, n_tokens int, ord array<bigint>, doc_id array<{kind}>, "
            "piece array<int>, doc_tokens array<int>, chunks array<binary>, bitmaps array<binary>, "
            "ranks array<binary>")


def segments(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
             end_id: int | None = 0, parts: int | None = None) -> DataFrame:
    """Segment rows of ``docs`` in ascending id order (see the module's text)."""
    spark = ready(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType
    rows = rows.repartitionByRange(parts or shuffle_width(spark), "id").sortWithinPartitions("id", "t")
    schema = _segment_schema(kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark.sql.pandas.types as types
        arrow_kind = types.to_arrow_type(kind)
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        table: list[tuple] = []
        state = {"n": 0, "seq": 0, "first": 0}

        def flush() -> pa.RecordBatch:
            levels = dac_encode(np.concatenate(held) if held else np.zeros(0, np.uint32))
            ords, ids, pieces, sizes = zip(*table)
            cells = [[part], [state["seq"]], [state["first"]], [state["n"]], [ords], [ids], [pieces], [sizes],
                     *([x] for x in levels)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                     pa.list_(arrow_kind), pa.list_(pa.int32()), pa.list_(pa.int32()),
                     *[pa.list_(pa.binary())] * 3]
            names = [f.split(" ")[0] for f in schema.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)
            state.update(n=0, seq=state["seq"] + 1, first=state["first"] + state["n"])
            held.clear()
            table.clear()
            return out

        number = 0
        for batch in batches:
            for rows_of in slices(batch, "t"):
                made, sizes = encode(rows_of["t"])
                last = np.cumsum(sizes)
                for doc, s, e in zip(rows_of["id"], (last - sizes).tolist(), last.tolist()):
                    ids = np.concatenate([made[s:e], end])
                    piece = at = 0
                    while True:
                        take = ids[at:at + SEGMENT - state["n"]]
                        held.append(take)
                        table.append((number, doc.as_py(), piece, len(take)))
                        state["n"] += len(take)
                        at, piece = at + len(take), piece + 1
                        if state["n"] == SEGMENT:
                            yield flush()
                        if at >= len(ids):
                            break
                    number += 1
        if table:
            yield flush()

    return rows.mapInArrow(run, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int | None = 0, parts: int | None = None) -> None:
    """Write the token files of ``docs`` below ``path``; Spark's committer publishes each
    part once, however often its task ran.

    Null and empty texts become the end id alone; rows that repeat an id follow one another
    (ties by text); null ids come first; an empty table writes no segment; columns other
    than id and text are not read.
    """
    segments(docs, tokenizer, id_col, text_col, end_id, parts).write.parquet(path)


# --- reading ----------------------------------------------------------------------

def part_starts(files: DataFrame) -> DataFrame:
    """``(part, start)``: tokens before each part; one row per file."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").cast("bigint").alias("n"))
    # as many rows as there are files: the window holds a directory, not data
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def crc_join(left: int, right: int, n_right: int) -> int:
    """crc32 of a + b from the crc32 of a, of b, and b's length in bytes."""
    zeros = bytes(n_right)
    return zlib.crc32(zeros, left) ^ zlib.crc32(zeros) ^ right


def token_digest(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document from segment rows."""
    ready(files)
    kind = files.schema["doc_id"].dataType.elementType
    files = files.join(F.broadcast(part_starts(files)), "part")  # one row per file
    rows = files.select("part", (F.col("start") + F.col("first")).alias("at"), "ord", "doc_id", "piece",
                        "doc_tokens", "chunks", "bitmaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = dac_decode(batch["chunks"][i].as_py(), batch["bitmaps"][i].as_py()
                                 ).astype("<u4").tobytes()
                n = batch["doc_tokens"][i].values.to_numpy()
                end = np.cumsum(n)
                begin = end - n
                crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), batch["part"][i].as_py(), np.int32)), batch["ord"][i].values,
                     batch["doc_id"][i].values, batch["piece"][i].values,
                     pa.array(begin + batch["at"][i].as_py(), pa.int64()), pa.array(n, pa.int32()),
                     pa.array(crc, pa.int64())],
                    ["part", "ord", "doc_id", "piece", "at", "n", "crc"])

    pieces = rows.mapInArrow(run, f"part int, ord bigint, doc_id {kind.simpleString()}, piece int, "
                                  "at bigint, n int, crc bigint")

    @F.udf("bigint")
    def joined(parts):
        crc = 0
        for p in parts:
            crc = crc_join(crc, p["crc"], 4 * p["n"])
        return crc

    docs = pieces.groupBy("part", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("start"),
        F.sum("n").cast("bigint").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("ps"))  # one per segment
    one = docs.where(F.size("ps") == 1).withColumn("ids_crc32", F.col("ps")[0]["crc"])
    more = docs.where(F.size("ps") > 1).withColumn("ids_crc32", joined("ps"))
    return one.unionByName(more).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokens_at(files: DataFrame, positions: DataFrame, pos_col: str = "pos") -> DataFrame:
    """``(pos, id)`` of global token positions; each touched segment is read once and only
    the wanted tokens are looked up.  Positions outside the data give no row."""
    ready(files)
    starts = part_starts(files).withColumn(
        "until", F.lead("start", 1, (1 << 62)).over(Window.orderBy("part")))
    wanted = positions.select(F.col(pos_col).cast("bigint").alias("pos")).where("pos >= 0").distinct()
    at = wanted.join(F.broadcast(starts), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("until")))
    at = at.select("part", F.floor((F.col("pos") - F.col("start")) / SEGMENT).cast("int").alias("seq"), "pos",
                   F.pmod(F.col("pos") - F.col("start"), F.lit(SEGMENT)).cast("int").alias("i"))
    at = at.groupBy("part", "seq").agg(F.collect_list(F.struct("pos", "i")).alias("want"))
    hit = files.select("part", "seq", "n_tokens", "chunks", "bitmaps", "ranks").join(at, ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                want = [(w["pos"], w["i"]) for w in row["want"] if w["i"] < row["n_tokens"]]
                if want:
                    pos, i = (np.array(x, np.int64) for x in zip(*want))
                    ids = dac_get(row["chunks"], row["bitmaps"], row["ranks"], i)
                    yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(ids.astype(np.int64))],
                                                     ["pos", "id"])

    return hit.mapInArrow(run, "pos bigint, id bigint")


def token_files(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(_segment_schema(kind)).parquet(path)
