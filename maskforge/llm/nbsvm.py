"""Quality classifier: naive-Bayes support vectors.

Indicators of hashed word n-grams (n = 1, 2) and word-shape n-grams (n = 1..3) are scaled by
the log-count ratio of the two classes, counted over every labelled training row; a linear
hinge-loss model on the scaled vectors (unit length) is fitted by dual coordinate descent
on a bounded sample of labelled rows; a logistic curve over margins of rows kept out of the
fit turns them into scores.

A word's shape is its letter case, digits, symbols, last character's kind, a length class,
and whether it repeats the word one or two places before, so n-grams over shapes carry
over to words never seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.llm.common import RangeHash, buffer_of, combine, mix, ready, sized_join, slices, word_spans

#: hashed n-gram indicators; also the bound of every table that reaches the driver
BUCKETS = 1 << 17
#: labelled rows of each class used to fit the hinge-loss model
FIT_ROWS = 1500
#: label rows up to which they are broadcast; beyond it the join shuffles
BROADCAST_LABELS = 1_000_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]~^_=+@\\/")] = True
_LAST = np.zeros(256, np.uint64)
for _k, _chars in enumerate((b".", b",", b"!", b"?", b";:", b"\"')", b"0123456789", b"-")):
    _LAST[list(_chars)] = _k + 1


def indicators(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of a slice of texts, sorted."""
    data, offsets = buffer_of(texts)
    starts, ends, docs = word_spans(data, offsets)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z
    word = RangeHash(data)(starts, ends)

    def inside(flag):
        total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return total[ends] - total[starts]

    upper, digit = inside((data >= 65) & (data <= 90)), inside((data >= 48) & (data <= 57))
    symbol, size = inside(_SYMBOL[data]), ends - starts
    first_upper = (data[starts] >= 65) & (data[starts] <= 90)
    case = np.where(upper == 0, 0, np.where((upper == 1) & first_upper, 1, np.where(2 * upper > size, 2, 3)))
    same = np.zeros(len(word), np.int64)
    for back in (2, 1):
        again = (word[back:] == word[:-back]) & (docs[back:] == docs[:-back])
        same[back:][again] = back
    shape = mix((case + 4 * (digit > 0) + 8 * np.minimum(symbol, 3) + 32 * same
                 + 128 * np.digitize(size, (2, 4, 8, 13, 30))).astype(np.uint64)
                + np.uint64(1 << 20) * _LAST[data[ends - 1]])
    keys = []
    for kind, (h, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        grams, at = combine(h, n, docs)
        bucket = (mix(grams + np.uint64(kind)) % np.uint64(buckets)).astype(np.int64)
        keys.append(docs[at] * buckets + bucket)
    found = np.unique(np.concatenate(keys))
    return found // buckets, found % buckets


@dataclass
class Model:
    """``weight`` already holds hinge-loss weight times log-count ratio."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, bucket = indicators(texts, len(self.weight))
        n = len(texts)
        total = np.bincount(doc, self.weight[bucket], n)
        norm = np.sqrt(np.bincount(doc, self.ratio[bucket] ** 2, n))
        margin = total / np.maximum(norm, 1e-9) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray,
            epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; weights over scaled indicators, bias."""
    values = []
    for r in rows:
        v = ratio[r]
        values.append((v / max(np.linalg.norm(v), 1e-9)).astype(np.float32))
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin) by damped Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows of ``docs``.

    Rows without a label, with a null label or null id teach nothing; repeated labels of
    an id count once (the smallest).  With one class, or none, every score is the share of
    label 1 (0.5 without labels).
    """
    ready(docs)
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    known = sized_join(texts, marks, "id", "inner", BROADCAST_LABELS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                y = part["y"].to_numpy()
                doc, bucket = indicators(part["t"], buckets)
                rows += np.bincount(y, minlength=2)
                for k in (0, 1):
                    total[k] += np.bincount(bucket[y[doc] == k], minlength=buckets)
        some = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
            np.r_[some, -1], np.r_[total[0][some], rows[0]], np.r_[total[1][some], rows[1]])], ["b", "n0", "n1"])

    counts = (known.mapInArrow(count, "b bigint, n0 bigint, n1 bigint")
              .groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())  # <= buckets rows
    place, hits = counts["b"].to_numpy(), np.stack([counts["n0"].to_numpy(), counts["n1"].to_numpy()])
    n0, n1 = (int(x) for x in hits[:, place < 0].sum(axis=1))
    zero = np.zeros(buckets)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    hit = np.full((2, buckets), SMOOTHING)
    hit[:, place[place >= 0]] += hits[:, place >= 0]
    del counts, place, hits
    ratio = np.log(hit[1] / hit[1].sum()) - np.log(hit[0] / hit[0].sum())

    # bounded sample of each class for the fit, by a hash of the id
    draw = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(11)), 11).cast("double") / float(1 << 53)
    marks = marks.where(draw < F.when(F.col("y") == 1, fit_rows / n1).otherwise(fit_rows / n0))
    known = sized_join(texts, marks, "id", "inner", BROADCAST_LABELS)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                doc, bucket = indicators(part["t"], buckets)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["y"], pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int32)))],
                    ["id", "y", "f"])

    kind = known.schema["id"].dataType.simpleString()
    sample = known.mapInArrow(rows_of, f"id {kind}, y int, f array<int>").toArrow()
    order = pc.sort_indices(sample["id"]).to_pylist()
    y = np.where(sample["y"].to_numpy() == 1, 1.0, -1.0)[order]
    rows = [np.asarray(sample["f"][i].values) for i in order]
    apart = np.arange(len(rows)) % 4 == 3  # margins of these rows calibrate the score
    fit = np.flatnonzero(~apart)
    if len({*y[fit]}) < 2 or len({*y[apart]}) < 2:
        fit = np.arange(len(rows))
        apart[:] = True
    share = np.array([(y[fit] < 0).mean(), (y[fit] > 0).mean()])
    cost = COST * 0.5 / share[(y[fit] > 0).astype(int)]
    w, bias = descend([rows[i] for i in fit], y[fit], ratio, cost, EPOCHS)
    margin = np.array([w[r] @ ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) + bias
                       for r, a in zip(rows, apart) if a])
    slope, offset = logistic(margin, y[apart])
    # the sample is balanced: move the offset to the classes' own shares
    offset += np.log(n1 / n0) - np.log(max((y[apart] > 0).mean(), 1e-9) / max((y[apart] < 0).mean(), 1e-9))
    return Model(w * ratio, ratio, float(bias), slope, float(offset))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with ``score_col`` in [0, 1]; null texts count as empty."""
    spark = ready(docs)
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # 2 x BUCKETS doubles, whatever the input
    rows = docs.select(*keep, F.col(text_col).alias("__t"))
    schema = docs.select(*keep).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__t"):
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in keep), pa.array(shared.value.score(part["__t"]))], [*keep, score_col])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is a multiple of 5: no label is learnt there."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
