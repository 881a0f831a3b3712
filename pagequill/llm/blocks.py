"""Texts in compressed blocks of bounded size, written once. A row is then named by its block and its place in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.packing import pack, unpack
from pagequill.llm.staging import ship, stage

BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 1 << 20
ROW_BITS = 24
NO_ID = np.iinfo(np.int64).min
SCHEMA = "block long, n_bytes long, n_rows long, ids binary, body binary, others binary"


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: list[str] | None = None) -> DataFrame:
    """``(block, n_bytes, n_rows, ids, body, others)``, staged. Null ids are kept as the smallest long, null texts as empty.

    ``others`` names columns whose values are to stay with the rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"), *[F.col(c).alias(f"other_{k}") for k, c in enumerate(others or [])])
    return stage(rows.mapInArrow(_cut, SCHEMA))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = rows = number = 0
    for batch in batches:
        at = 0
        lengths = np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:  # a block ends with the text that fills it
            done = lengths[at - 1] if at else 0
            to = min(batch.num_rows, at + BLOCK_ROWS - rows, int(np.searchsorted(lengths, done + BLOCK_BYTES - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(lengths[to - 1] - done)
            rows += to - at
            at = to
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                yield _block(held, number)
                held, size, rows, number = [], 0, 0, number + 1
    if held:
        yield _block(held, number)


def _block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    name = (table.column("part")[0].as_py() << 16) | number
    ids = table.column("id").fill_null(NO_ID).to_numpy()
    data = table.column("text").cast(pa.large_binary()).fill_null(b"").combine_chunks()
    lengths = pc.binary_length(data).to_numpy().astype(np.int64)
    _, bounds, body = data.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(data) + 1, data.offset * 8)
    body = body.to_pybytes()[bounds[0] : bounds[-1]] if body is not None else b""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name], pa.int64()),
            pa.array([len(body)], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.array([pack(np.diff(ids, prepend=np.int64(0)), lengths)], pa.binary()),
            pa.array([zstandard.compress(body, 3)], pa.binary()),
            pa.array([_packed(table.select([c for c in table.column_names if c.startswith("other_")]))], pa.binary()),
        ],
        ["block", "n_bytes", "n_rows", "ids", "body", "others"],
    )


def each_block(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, pa.Buffer]]:
    """Name, ids and body of one block after the other; the bodies of a batch are not copied."""
    for row in range(batch.num_rows):
        yield batch.column("block")[row].as_py(), batch.column("ids")[row].as_py(), batch.column("body")[row].as_buffer()


def open_block(ids: bytes, body: bytes | pa.Buffer) -> tuple[np.ndarray, pa.Array]:
    """The ids and the texts (as large binaries) of a block. A row is named by ``block << ROW_BITS | place``."""
    steps, lengths = unpack(ids)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    data = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(zstandard.decompress(body))])
    return np.cumsum(steps), data


def _packed(table: pa.Table) -> bytes | None:
    if not table.num_columns:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def other_columns(others: bytes) -> list[pa.ChunkedArray]:
    """The columns kept with a block's rows, in the order they were named."""
    return pa.ipc.open_stream(zstandard.decompress(others)).read_all().columns


def rows_of(blocks: DataFrame, marks: DataFrame, function, schema, columns: tuple[str, ...] = ("ids", "body", "others")) -> DataFrame:
    """``function(block, marks)`` as tables for every block, with the marks that name it."""
    return blocks.select("block", *columns).groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(function, schema)
