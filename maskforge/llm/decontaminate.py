"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts and test items are lower-cased and cut into words (runs of ASCII letters, digits and
non-ASCII characters).  Seeds are the five-word shingles of an item with one word left
open: four neighbouring words, or five with the second, third or fourth open.  Their hash does
not tell which word was open, so a seed is also found where a copy adds or drops that word.  A
seed is rare when the product of its words' shares in the whole corpus is at most ``RARE``, so
frequent copies of an item do not make its seeds frequent; besides these an item keeps the rarest
seed of every ``SHINGLE`` places, and its ``LEAST_SEEDS`` rarest in any case.  Where seeds hit, the text around them is aligned with the item by words
(Smith-Waterman, linear gaps); a text is contaminated when the best alignment matches at
least ``SIMILARITY`` of the item's words.

Items are a stated query set: they are carried to the texts in blocks of at most
``BLOCK_WORDS`` words, one pass over the texts for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.llm.common import (
    NOT_ALNUM, RangeHash, buffer_of, mix, ready, slices, word_spans,
)

SHINGLE = 5
SIMILARITY = 0.8
RARE = 1e-8
LEAST_SEEDS = 8
BLOCK_WORDS = 1_000_000
#: items with fewer words cannot be told from ordinary prose and match nothing
LEAST_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: word offsets of the seeds within a five-word shingle
SEEDS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
_TABLE_BITS = 22


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the text number of each word."""
    data, offsets = buffer_of(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, docs = word_spans(data, offsets, NOT_ALNUM)
    return (RangeHash(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)), docs


def seed_hashes(words: np.ndarray, kind: int) -> np.ndarray:
    """Seed of one kind at every position that has room for it (texts may be crossed); seeds of
    equal words are equal, whatever their kind."""
    offsets = SEEDS[kind]
    n = max(0, len(words) - offsets[-1])
    h = np.ones(n, np.uint64)
    for k in offsets:
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
    return mix(h)


class HashSet:
    """Sorted hashes behind a fixed table of bits that answers most look-ups."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(keys & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are members, and their places in ``keys``."""
        at = np.flatnonzero(self.table[(h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[where] == h[at]
        return at[hit], where[hit]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Matched words of the best local alignment (most matches among equal scores) and the
    text place after its last word."""
    unit = 1 << 24  # score in the upper part, matches in the lower
    n = len(text)
    gap = np.arange(n + 1, dtype=np.int64) * (-GAP * unit)
    row = np.zeros(n + 1, np.int64)
    best, best_end = 0, 0
    for word in item:
        step = np.where(text == word, MATCH * unit + 1, MISMATCH * unit)
        new = np.maximum(row[1:] + GAP * unit, row[:-1] + step)
        new = np.maximum(np.r_[0, new], 0)
        # a gap along the text: the best of all earlier cells less the gap's cost
        new = np.maximum(new, np.maximum.accumulate(new + gap) - gap)
        new[new < unit] = 0
        row = new
        top = int(row.argmax())
        if row[top] > best:
            best, best_end = int(row[top]), top
    return best % unit, best_end


@dataclass
class Items:
    """A block of test items with their rare seeds."""

    ids: list
    words: list[np.ndarray]
    seeds: HashSet
    item: np.ndarray    # per seed entry, sorted by seed
    offset: np.ndarray
    first: np.ndarray   # per distinct seed: its first entry
    count: np.ndarray

    @staticmethod
    def build(ids: list, words: list[np.ndarray], share: dict[int, float]) -> "Items":
        keys, of, at = [], [], []
        for i, w in enumerate(words):
            log = np.log10(np.array([share[int(x)] for x in w]))
            key, cost, place = [], [], []
            for kind, offsets in enumerate(SEEDS):
                h = seed_hashes(w, kind)
                key.append(h)
                cost.append(sum((log[k:k + len(h)] for k in offsets), np.zeros(len(h))))
                place.append(np.arange(len(h)))
            key, cost, place = (np.concatenate(x) for x in (key, cost, place))
            rare = cost <= np.log10(RARE)
            order = np.lexsort((cost, place // SHINGLE))  # the rarest of each part of the item
            rare[order[np.unique(place[order] // SHINGLE, return_index=True)[1]]] = True
            if rare.sum() < LEAST_SEEDS:
                rare[np.argsort(cost, kind="stable")[:LEAST_SEEDS]] = True
            keys.append(key[rare])
            of.append(np.full(rare.sum(), i))
            at.append(place[rare])
        keys, of, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, of, at))
        order = np.argsort(keys, kind="stable")
        distinct, first, count = np.unique(keys[order].astype(np.uint64), return_index=True, return_counts=True)
        return Items(ids, words, HashSet(distinct), of[order], at[order], first, count)

    def matches(self, texts: pa.Array, similarity: float) -> list[tuple[int, int, float, int, int]]:
        """``(text, item, similarity, first word, last word + 1)`` of contaminated texts."""
        words, docs = words_of(texts)
        place, seed = [], []
        for kind in range(len(SEEDS)):
            h = seed_hashes(words, kind)
            at, which = self.seeds.find(h)
            inside = docs[at] == docs[at + SEEDS[kind][-1]]
            place.append(at[inside])
            seed.append(which[inside])
        place, seed = np.concatenate(place), np.concatenate(seed)
        if not len(place):
            return []
        n = self.count[seed]
        entry = np.repeat(self.first[seed] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        place = np.repeat(place, n)
        item, diagonal, doc = self.item[entry], place - self.offset[entry], docs[place]
        hits = np.unique(np.stack([doc, item, diagonal], axis=1), axis=0)
        doc, item, diagonal = hits.T
        begin = np.searchsorted(docs, np.arange(len(texts) + 1))
        length = np.array([len(w) for w in self.words])[item]
        # diagonals of a text and item that are near each other share a window
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                                    | (diagonal[1:] - diagonal[:-1] > length[1:])])
        tail = np.r_[head[1:] - 1, len(doc) - 1]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for h, t in zip(head.tolist(), tail.tolist()):
            d, i = int(doc[h]), int(item[h])
            w = self.words[i]
            slack = len(w) // 2 + 2
            lo = max(int(begin[d]), int(diagonal[h]) - slack)
            hi = min(int(begin[d + 1]), int(diagonal[t]) + len(w) + slack)
            window = words[lo:hi]
            if np.isin(w, window).sum() < similarity * len(w):
                continue  # fewer common words than the alignment would need
            matched, end = align(w, window)
            share = matched / len(w)
            if share >= similarity and share > best.get((d, i), (0.0,))[0]:
                best[d, i] = (share, max(lo, lo + end - len(w)) - int(begin[d]), lo + end - int(begin[d]))
        return [(d, i, *found) for (d, i), found in sorted(best.items())]


def word_shares(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> dict[int, float]:
    """Share of each word of ``vocabulary`` among all words of the corpus."""
    known = HashSet(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                words, _ = words_of(part["t"])
                total[-1] += len(words)
                total[:-1] += np.bincount(known.find(words)[1], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["w", "n"])

    counted = (docs.select(F.col(text_col).alias("t")).mapInArrow(run, "w bigint, n bigint")
               .groupBy("w").agg(F.sum("n").alias("n")).toPandas())  # a row per word of the items
    total = np.zeros(len(vocabulary) + 1)
    total[counted["w"].to_numpy(np.int64)] = counted["n"]
    every = max(total[-1], 1.0)
    return {int(w): max(c, 1.0) / every for w, c in zip(vocabulary, total[:-1])}


def item_blocks(items: DataFrame, docs: DataFrame, item_col: str, item_text: str, text_col: str,
                block_words: int = BLOCK_WORDS) -> list[Items]:
    """The test items, with seeds rated on the whole corpus, in blocks of bounded size."""
    rows = items.select(F.col(item_col).alias("id"), F.col(item_text).alias("t")).where(
        "id is not null and t is not null").orderBy("id", "t")
    blocks: list[tuple[list, list]] = []
    held = 0
    for row in rows.toLocalIterator():
        words, _ = words_of(pa.array([row["t"]]))
        if len(words) < LEAST_WORDS:
            continue
        if not blocks or held + len(words) > block_words:
            blocks.append(([], []))
            held = 0
        blocks[-1][0].append(row["id"])
        blocks[-1][1].append(words)
        held += len(words)
    out = []
    for ids, words in blocks:
        share = word_shares(docs, np.unique(np.concatenate(words)), text_col)
        out.append(Items.build(ids, words, share))
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(<id_col>, <item_col>, similarity, first_word, end_word)``: one row per row of ``docs``
    and test item it holds a copy of.

    ``similarity`` is the matched share of the item's words.  Null and empty texts, items
    without id or text, and items shorter than ``LEAST_WORDS`` match nothing; repeated rows
    give repeated rows; no items or no texts give an empty result; extra columns are not
    read.
    """
    spark = ready(docs)
    id_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    schema = f"id {id_kind}, item {item_kind}, similarity double, first_word bigint, end_word bigint"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, docs, item_col, item_text, text_col):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part in slices(batch, "t"):
                    found = block.matches(part["t"], similarity)
                    if found:
                        doc, item, share, first, end = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [part["id"].take(pa.array(doc)), pa.array([block.ids[i] for i in item]),
                             pa.array(share), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                            ["id", "item", "similarity", "first_word", "end_word"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose text holds a copy of a test item; each row is judged
    where it stands, so nothing is shuffled and repeated or null ids do not matter."""
    spark = ready(docs)
    out = docs
    for block in item_blocks(items, docs, item_col, item_text, text_col):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    held = {m[0] for m in shared.value.matches(part[text_col], similarity)}
                    yield part.filter(pa.array([i not in held for i in range(part.num_rows)]))

        out = out.mapInArrow(run, docs.schema)
    return out
