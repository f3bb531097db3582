"""Rows in packs of a few MB of text, as compressed Arrow data.

A pack is a row of its own. It is written once, meets what was found out about its texts by one join on its number, and is
small on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def opened(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as reader:
        return reader.read_all().combine_chunks().to_batches()[0]


def closed(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for part in parts:
            writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def packs(rows: DataFrame, text: str, pack_bytes: int) -> DataFrame:
    """(pack, size, blob): all rows in their order, in packs of about ``pack_bytes`` of text. A row is never cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, total, number = [], 0, TaskContext.get().partitionId() << 33

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pack": pa.array([number], pa.int64()), "size": pa.array([total], pa.int64()),
                                               "blob": pa.array([closed(held)], pa.binary())})

        for batch in batches:
            sizes = np.cumsum([len(t) + 1 for t in texts_of(batch, text)])
            begin = 0
            while begin < batch.num_rows:
                spent = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, spent + pack_bytes - total, "right")))
                held.append(batch.slice(begin, end - begin))
                total += int(sizes[end - 1] - spent)
                begin = end
                if total >= pack_bytes or begin < batch.num_rows:
                    yield done()
                    held, total, number = [], 0, number + 1
        if held:
            yield done()

    return rows.mapInArrow(run, "pack long, size long, blob binary")
