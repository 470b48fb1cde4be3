import pyarrow as pa

from weftline.llm.common import slices


def test_slices_hold_every_row_once_and_keep_to_the_bound():
    texts = ["", None, "a" * 5, "b" * 30, "é" * 4, None, "c", "", "d" * 9, "e" * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([b"xy"] * len(texts), pa.binary())], ["id", "text", "data"])
    parts = list(slices(batch, 16))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    for p in parts:
        size = sum(len((t or "").encode()) + 2 for t in p.column(1).to_pylist())
        assert p.num_rows == 1 or size <= 16
    assert list(slices(batch.slice(0, 0))) == [] and len(list(slices(batch))) == 1
    assert [p.num_rows for p in slices(batch.slice(2, 3), 16)] == [1, 1, 1]
