"""Memory of a task that removes repeated strings: hashing and refining go by small pieces of the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tabsmith.llm import suffix


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashing_a_batch_takes_little_memory():
    data = np.random.default_rng(1).integers(97, 123, 4 << 20).astype(np.uint8)
    offsets = np.arange(0, len(data) + 1, 4096)
    assert peak(lambda: sum(len(s[0]) for s in suffix._segments(data, offsets))) < 40 << 20


def test_refining_a_batch_takes_little_memory():
    n = 20_000
    bodies = np.random.default_rng(2).integers(97, 123, 160 * n).astype(np.uint8).reshape(n, 160)
    bodies[1::2] = bodies[::2]  # every bucket holds a repeat
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n) // 2), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array([b.tobytes() for b in bodies], pa.binary())],
        names=["bucket", "doc_id", "start", "body"])
    found = []
    assert peak(lambda: found.extend(suffix._refine_rows(iter([batch])))) < 40 << 20
    rows = pa.Table.from_batches(found).to_pydict()
    assert rows["doc_id"] == list(range(1, n, 2)) and set(rows["lo"]) == {0} and set(rows["hi"]) == {160}
