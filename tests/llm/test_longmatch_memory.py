"""Arrays of a task stay small however much text a batch brings, and cuts find the same segments."""

import random
import tracemalloc

import pyarrow as pa

from maskforge.llm import longmatch as L


class _Rows:
    def mapInArrow(self, run, schema):
        return run


def _segments(batch):
    return [tuple(r.values()) for b in L._all_segments(_Rows(), 400, 64)(iter([batch])) for r in b.to_pylist()]


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "t"])


def test_segments_of_a_batch_are_made_in_small_parts():
    rng = random.Random(2)
    batch = _batch(["".join(rng.choices("abcdefgh ", k=8000)) for _ in range(256)])
    _segments(batch.slice(0, 2))
    tracemalloc.start()
    run = L._all_segments(_Rows(), 400, 64)(iter([batch]))
    n = sum(b.num_rows for b in run)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 5000 and peak < 64 << 20


def test_parts_find_the_segments_of_whole_texts(monkeypatch):
    rng = random.Random(3)
    batch = _batch(["".join(rng.choices("abcdefgh ", k=rng.randint(0, 3000))) for _ in range(60)] + ["é" * 900, "", "x" * 2000])
    whole = _segments(batch)
    monkeypatch.setattr(L, "PART_BYTES", 1)
    assert sorted(_segments(batch)) == sorted(whole) and len(whole) > 100
