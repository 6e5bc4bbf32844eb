"""Phrase collocations by SON partitioning.

Documents are dealt into ``SHARDS`` shards.  A shard is mined completely, level by level, at the
support lowered in proportion to its share of a language's words: a phrase found ``least`` times
in all is found at least ``ceil(least * words of the shard / words of the language)`` times in
some shard.  In a shard a phrase is only counted when its shorter phrases are frequent there.  The
phrases that are frequent in any shard are then counted exactly over all documents, and collocations
are scored from those counts alone.

Candidates are searched by 64-bit hashes and bitmaps of ``FILTER_BITS`` bits, whose errors can only
add candidates; exact counts compare the phrases themselves.  A task adds up equal phrases and packs
them in blocks by hash bucket, so the shuffle moves blocks instead of single phrases, and a frequent
phrase or language is one entry per task and not a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskforge.llm.common import (
    RangeHash, buffer_of, mix, ready, shuffle_width, sized_join, slices, staged, word_spans)

LEAST = 30
LONGEST = 4
TOP = 2000
SHARDS = 4
#: size of a bitmap of frequent phrases; when it fills up, more phrases are counted, none is lost
FILTER_BITS = 1 << 26
#: occurrences brought together in a task before equal ones are added up
CHUNK = 2_000_000
#: (language, shard) rows up to which their table is broadcast
SMALL = 10_000
#: salts of the first step of the top-k per language
SALTS = 64

PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(10, 14)]] = True
BLANK = PIECE_END.copy()
BLANK[[9, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd
_LEVEL = mix(np.arange(1, LONGEST + 1, dtype=np.uint64))

_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK = {"bucket": pa.int32(), "l": _LONGS, "s": _INTS, "support": _LONGS, "n": _INTS, "h": pa.binary(), "c": pa.binary()}
_PHRASES = {"bucket": pa.int32(), "lang": pa.list_(pa.string()), "size": _LONGS, "n": _INTS, "p": pa.binary(),
            "a": pa.binary()}


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("l"),
                       F.pmod(F.xxhash64(id_col), F.lit(SHARDS)).cast("int").alias("s"), F.col(text_col).alias("t"))


class Words:
    """Words of a slice of texts: lower-cased, with the piece each one is in."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = buffer_of(part["t"])
        self.data = LOWER[data]
        self.starts, self.ends, self.docs = word_spans(self.data, offsets, BLANK)
        self.piece = np.r_[0, np.cumsum(PIECE_END[self.data])][self.starts] + self.docs
        self.lang = mix(part["l"].to_numpy().view(np.uint64))
        self.hashes = RangeHash(self.data)(self.starts, self.ends)

    def first_words(self, n: int, good: np.ndarray | None = None, known: int = 1) -> np.ndarray:
        """First words of the phrases of ``n`` words; with ``good`` (a flag for the first word of
        every phrase of ``known`` words) of those alone that hold only good ones."""
        m = len(self.starts) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        keep = self.piece[:m] == self.piece[n - 1:]
        if good is not None:
            for k in range(n - known + 1):
                keep &= good[k:k + m]
        return np.flatnonzero(keep)

    def grams(self, n: int, at: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hash (language included) of the phrases of ``n`` words that begin at ``at``."""
        hashes = self.hashes if hashes is None else hashes
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _STEP + hashes[at + k]
        return mix(h ^ self.lang[self.docs[at]] ^ _LEVEL[n - 1])


def _group(l: np.ndarray, s: np.ndarray) -> np.ndarray:
    """64 bits that stand for a language's shard."""
    return mix(l.view(np.uint64) ^ mix(s.astype(np.uint64) + np.uint64(1)))


def _bit(keys: np.ndarray, size: int) -> np.ndarray:
    return mix(keys) & np.uint64(size - 1)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    b = _bit(keys, 64 * len(bits))
    return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def _buckets(df: DataFrame) -> int:
    """Buckets (a power of two) that entries are dealt into: one at least for a shuffle partition."""
    return 1 << (shuffle_width(df.sparkSession) - 1).bit_length()


def _frequent_here(words: Words, group: np.ndarray, known: int, bits: np.ndarray) -> np.ndarray:
    """A flag for every word: whether the phrase of ``known`` words that begins there is frequent
    in its shard."""
    first = words.first_words(known)
    good = np.zeros(len(words.starts), bool)
    good[first] = _has(bits, words.grams(known, first) ^ group[words.docs[first]])
    return good


def _blocks(rows: DataFrame, levels: tuple[int, ...], known: int, bits) -> DataFrame:
    """Occurrences of phrases of the given lengths, added up in the task and packed: a row for each
    bucket, with languages, shards, supports, numbers of entries, and the entries' hashes and counts
    as bytes."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes
    chunk, buckets = CHUNK, _buckets(rows)
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        groups: dict[tuple, int] = {}

        def result():
            hashes, code = (np.concatenate([x[i] for x in held]) for i in range(2))
            out: dict[int, list] = {}
            for group, k in groups.items():
                h = np.sort(hashes[code == k])
                if not len(h):
                    continue
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                h, c = h[first], np.diff(np.r_[first, len(h)]).astype(np.int64)
                bucket = (h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
                cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(h)].tolist()
                for x, y in zip(cut[:-1], cut[1:]):
                    out.setdefault(int(bucket[x]), []).append((*group, y - x, h[x:y].tobytes(), c[x:y].tobytes()))
            for bucket, parts in sorted(out.items()):
                l, s, support, n, h, c = zip(*parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip((bucket, l, s, support, n, b"".join(h), b"".join(c)), _BLOCK.values())],
                    list(_BLOCK))

        for batch in batches:
            for part in slices(batch, "t"):
                words = Words(part)
                l, s = part["l"].to_numpy(), part["s"].to_numpy()
                group = _group(l, s)
                code = np.array([groups.setdefault(g, len(groups)) for g in zip(
                    l.tolist(), s.tolist(), part["support"].to_pylist())], np.int32)
                good = None if shared is None else _frequent_here(words, group, known, shared.value)
                for n in levels:
                    at = words.first_words(n, good, known)
                    held.append((words.grams(n, at), code[words.docs[at]]))
                    size += len(at)
                if size >= chunk:
                    yield from result()
                    held, size = [], 0
        if size:
            yield from result()

    return rows.select("t", "l", "s", "support").mapInArrow(
        run, "bucket int, l array<bigint>, s array<int>, support array<bigint>, n array<int>, h binary, c binary")


def _frequent(blocks: DataFrame) -> DataFrame:
    """``(l, s, h)`` of phrases with the support of their language and shard.  The blocks of a
    bucket meet in one task, which holds one bucket at a time."""
    dealt = blocks.repartition(shuffle_width(blocks.sparkSession), "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        at = None

        def result():
            for (l, s, support), parts in held.items():
                h = np.concatenate([x[0] for x in parts])
                c = np.concatenate([x[1] for x in parts])
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                h = h[first][np.add.reduceat(c[order], first) >= support]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), l, np.int64)), pa.array(
                    np.full(len(h), s, np.int32)), pa.array(h.view(np.int64))], ["l", "s", "h"])

        for batch in batches:
            for k, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket != at:
                    yield from result()
                    held.clear()
                    at = bucket
                h = np.frombuffer(batch["h"][k].as_py(), np.uint64)
                c = np.frombuffer(batch["c"][k].as_py(), np.int64)
                lists = [batch[name][k].as_py() for name in ("l", "s", "support", "n")]
                begin = 0
                for l, s, support, n in zip(*lists):
                    held.setdefault((l, s, support), []).append((h[begin:begin + n], c[begin:begin + n]))
                    begin += n
        yield from result()

    return dealt.mapInArrow(run, "l bigint, s int, h bigint")


def _bitmap(frequent: DataFrame, by_shard: bool) -> np.ndarray:
    """Bitmap of fixed size over frequent phrases, of their shards or of all: no false negatives."""
    size = FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["h"].to_numpy().view(np.uint64)
            if by_shard:
                h = h ^ _group(batch["l"].to_numpy(), batch["s"].to_numpy())
            b = _bit(h, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array((b >> np.uint64(6)).astype(np.int32)),
                 pa.array((np.uint64(1) << (b & np.uint64(63))).view(np.int64))], ["w", "b"])

    words = (frequent.select("l", "s", "h").mapInArrow(run, "w int, b bigint")
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())  # FILTER_BITS / 64 rows at most
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return bits


def supports(rows: DataFrame, least: int) -> DataFrame:
    """``(lang, s, n, support)``: words of a language, and the support of its phrases in a shard,
    lowered in proportion to the shard's words; a row for each language and shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                data, offsets = buffer_of(part["t"])
                n = np.bincount(word_spans(data, offsets, BLANK)[2], minlength=part.num_rows)
                for key, more in zip(zip(part["lang"].to_pylist(), part["s"].to_pylist()), n.tolist()):
                    total[key] = total.get(key, 0) + more
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()),
             pa.array(list(total.values()), pa.int64())], ["lang", "s", "c"])

    words = rows.select("t", "lang", "s").mapInArrow(run, "lang string, s int, c bigint")
    sizes = words.groupBy("lang", "s").agg(F.sum("c").cast("decimal(38,0)").alias("c")).where("c > 0")
    whole = sizes.groupBy("lang").agg(F.sum("c").cast("decimal(38,0)").alias("n"))
    return staged(sizes.join(whole, "lang").select("lang", "s", F.col("n").cast("bigint").alias("n"), F.expr(
        f"(CAST({least} AS DECIMAL(20,0)) * c + n - 1) div n").alias("support")), "phrase-support")


def shard_frequent(rows: DataFrame) -> list[DataFrame]:
    """Phrases frequent in some shard: staged ``(l, s, h)`` tables, one for each mining step."""
    found: list[DataFrame] = []
    for known, levels in ((0, (1,)), (1, (2,)), (2, tuple(range(3, LONGEST + 1)))):
        bits = _bitmap(found[-1], True) if found else None
        found.append(staged(_frequent(_blocks(rows, levels, known, bits)), f"phrase-level{known + 1}"))
    return found


def phrase_counts(rows: DataFrame, candidates: np.ndarray, least: int) -> DataFrame:
    """``(lang, phrase, a)``: exact occurrences, over all rows, of the phrases in the bitmap that
    are found ``least`` times.  Phrases are compared as text, in tasks and between them."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)  # FILTER_BITS / 8 bytes
    chunk, width, buckets = CHUNK, shuffle_width(rows.sparkSession), _buckets(rows)
    shift = 64 - (buckets.bit_length() - 1)

    def table(data: np.ndarray, cut: np.ndarray, **more) -> pa.Table:
        text = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])
        return pa.table({"p": text, **more})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def result():
            out: dict[int, list] = {}
            for lang, parts in held.items():
                data, long, h = (np.concatenate([x[i] for x in parts]) for i in range(3))
                t = table(data, np.r_[0, np.cumsum(long)].astype(np.int64), h=h)
                t = t.group_by("p").aggregate([("h", "min"), ("h", "count")])
                bucket = (t["h_min"].to_numpy() >> np.uint64(shift)).astype(np.int64) if buckets > 1 \
                    else np.zeros(len(t), np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, p = bucket[order], t["p"].combine_chunks().take(pa.array(order))
                a = t["h_count"].to_numpy()[order].astype(np.int64)
                ends = np.frombuffer(p.buffers()[1], np.int64)[:len(p) + 1]
                raw = p.buffers()[2].to_pybytes() if len(p) else b""
                cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(p)].tolist()
                for x, y in zip(cut[:-1], cut[1:]):
                    out.setdefault(int(bucket[x]), []).append((lang, int(ends[y] - ends[x]), y - x, raw[ends[x]:ends[y]],
                                                               a[x:y].tobytes()))
            for bucket, parts in sorted(out.items()):
                lang, size_of, n, p, a = zip(*parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip((bucket, lang, size_of, n, b"".join(p), b"".join(a)), _PHRASES.values())],
                    list(_PHRASES))

        for batch in batches:
            for part in slices(batch, "t"):
                words = Words(part)
                if not len(words.starts):
                    continue
                names = part["lang"].to_pylist()
                code = np.array([sorted(set(names)).index(x) for x in names])
                # words again, one blank after each, so that a phrase is a run of bytes
                long = words.ends - words.starts
                put = np.r_[0, np.cumsum(long + 1)]
                text = np.full(put[-1], 32, np.uint8)
                step = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                text[np.repeat(put[:-1], long) + step] = words.data[np.repeat(words.starts, long) + step]
                good = None
                for n in range(1, LONGEST + 1):
                    # a candidate's shorter phrases are candidates
                    at = words.first_words(n, good, n - 1)
                    h = words.grams(n, at)
                    keep = _has(shared.value, h)
                    h, at = h[keep], at[keep]
                    good = np.zeros(len(words.starts), bool)
                    good[at] = True
                    of = code[words.docs[at]]
                    for k, lang in enumerate(sorted(set(names))):
                        mine = np.flatnonzero(of == k)
                        if not len(mine):
                            continue
                        lo = put[at[mine]]
                        size_of = put[at[mine] + n] - lo
                        ends = np.cumsum(size_of)
                        data = text[np.arange(ends[-1]) + np.repeat(lo - (ends - size_of), size_of)]
                        data[ends - 1] = 10  # no phrase holds a line end: it closes each
                        held.setdefault(lang, []).append((data, size_of, h[mine]))
                        size += len(mine)
                if size >= chunk:
                    yield from result()
                    held.clear()
                    size = 0
        if size:
            yield from result()

    blocks = (rows.select("lang", "l", "t").mapInArrow(
        packed, "bucket int, lang array<string>, size array<bigint>, n array<int>, p binary, a binary")
        .repartition(width, "bucket").sortWithinPartitions("bucket"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        at = None

        def result():
            for lang, parts in held.items():
                data = np.frombuffer(b"".join(x[0] for x in parts), np.uint8)
                cut = np.r_[0, np.flatnonzero(data == 10) + 1].astype(np.int64)
                t = table(data, cut, a=np.frombuffer(b"".join(x[1] for x in parts), np.int64))
                t = t.group_by("p").aggregate([("a", "sum")])
                t = t.filter(pc.greater_equal(t["a_sum"], least))
                text = [p[:-1].decode() for p in t["p"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.string()),
                                                  t["a_sum"].combine_chunks().cast(pa.int64())], ["lang", "phrase", "a"])

        for batch in batches:
            for k, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket != at:
                    yield from result()
                    held.clear()
                    at = bucket
                p, a = batch["p"][k].as_py(), batch["a"][k].as_py()
                begin = first = 0
                for lang, size_of, n in zip(*(batch[name][k].as_py() for name in ("lang", "size", "n"))):
                    held.setdefault(lang, []).append((p[begin:begin + size_of], a[8 * first:8 * (first + n)]))
                    begin, first = begin + size_of, first + n
        yield from result()

    return blocks.mapInArrow(counted, "lang string, phrase string, a bigint")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(known: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Scored phrases per language from the exact counts ``(lang, phrase, a)`` of all frequent
    phrases and words, and the languages' words ``(lang, n)``."""
    words = known.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w")).where("k > 1")

    def run_of(begin, length):
        return F.array_join(F.slice("w", begin, length), " ")

    cuts = words.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", run_of(F.lit(1), F.col("cut")).alias("left"),
        run_of(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn(
        "score", F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div "
                        "(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select(
        "lang", "phrase", "a", "m.l", "m.r", "m.score")
    parts = words.where("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn(
        "b", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    longer = (parts.select("lang", run_of(F.col("b"), F.col("m")).alias("phrase"), F.col("a").alias("f"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    held = F.col("f").isNotNull() & (F.lit(100) * _exact("f") >= F.lit(80) * _exact("a"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(~held).drop("f")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    first = (kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
             .withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top))
    # SALTS * top rows of a language at most
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l",
                                              "r", "n", "score")


def phrase_collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                        least: int = LEAST, top: int = TOP) -> DataFrame:
    """Best ``top`` phrases of two to four words of every language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs.  Null
    languages are ``und``; null and empty texts hold no word; repeated rows count again; null ids
    share a shard.  An empty table, or one without a phrase found ``least`` times, gives no rows.
    """
    ready(docs)
    rows = _rows(docs, id_col, text_col, lang_col)
    support = supports(rows, least)
    found = shard_frequent(sized_join(rows, support.select("lang", "s", "support"), ["lang", "s"], "inner", SMALL))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    counts = staged(phrase_counts(rows, _bitmap(union, False), least), "phrase-counts")
    return collocations(counts, support.select("lang", "n").distinct(), top)


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The same by counting every phrase, for DuckDB."""
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS phrase, {n} AS k FROM pieces, "
        f"LATERAL (SELECT unnest(range(1, len(w) - {n - 2})) AS i)" for n in range(1, LONGEST + 1))
    return f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
known AS (SELECT lang, phrase, k, count(*)::HUGEINT AS a FROM (
  {grams}) GROUP BY lang, phrase, k HAVING count(*) >= {least}),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM known WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
  FROM cand c, LATERAL (SELECT unnest(range(1, c.k)) AS cut)),
scored AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, (2000000 * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = lp JOIN known y ON y.lang = c.lang AND y.phrase = rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, sub, max(a) AS f FROM (
  SELECT c.lang, c.a, array_to_string(w[b:b + m - 1], ' ') AS sub FROM cand c,
    LATERAL (SELECT unnest(range(2, c.k)) AS m), LATERAL (SELECT unnest(range(1, c.k - m + 2)) AS b)) GROUP BY lang, sub),
kept AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.sub = s.phrase
  WHERE g.f IS NULL OR NOT (100 * g.f >= 80 * s.a))
SELECT k.lang, k.rank::BIGINT AS rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, t.n::BIGINT AS n,
  k.score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang WHERE k.rank <= {top}
"""
