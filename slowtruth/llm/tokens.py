"""Token counts by separator scan over flat, unindexed token files.

A flat token file is nothing but token ids of a fixed width, one document after another, each closed by an
end-of-document id. There is no index, so a document's length is the distance of two separators. The scan
takes blocks of a file in any order: within a block, separators are found with one vectorised comparison;
documents that cross a border are stitched by a prefix scan over one small row for each block.

A file may hold one document of any length or a third of all tokens: blocks are independent, and the prefix
scan runs over groups of blocks first, so no task sees more than a bounded number of block rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from slowtruth.llm.common import take
from slowtruth.session import materialize

#: Byte-level vocabulary: id = byte + 3; 0 pad, 1 end of document, 2 unknown.
BYTE_SHIFT, END_ID, WIDTH = 3, 1, 2
#: Small enough that a reader or Arrow batch of several thousand blocks stays at some tens of MB.
BLOCK_TOKENS = 1 << 13
GROUP_BLOCKS = 1024
BLOCKS = "file string, block long, tokens binary"


def byte_ids(texts: list[str | None]) -> list[np.ndarray]:
    """Ids of the byte-level vocabulary; a null text is an empty one."""
    return [np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8).astype(np.uint16) + BYTE_SHIFT for t in texts]


def tokenizer_ids(path: str, end_id: int) -> Callable[[list[str | None]], list[np.ndarray]]:
    """Ids of a tokenizer file (``tokenizer.json``). An id equal to ``end_id`` inside a text is refused."""
    def encode(texts: list[str | None]) -> list[np.ndarray]:
        from tokenizers import Tokenizer

        if path not in _LOADED:
            _LOADED[path] = Tokenizer.from_file(path)
        out = [np.array(e.ids, np.uint32) for e in _LOADED[path].encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if any((ids == end_id).any() for ids in out):
            raise ValueError("a text holds the end-of-document id")
        return out

    return encode


_LOADED: dict = {}


def write_token_stream(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", encode=byte_ids, end_id: int = END_ID,
                       width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode documents into flat token files, stored as a table of fixed-size blocks in the shared folder.

    (file, block, tokens, first, ids): each task writes one file; the tokens are little-endian, ``width`` bytes each.
    ``ids`` are the ids of the documents that end in the block and ``first`` the ordinal of the first of them: what a
    writer knows and the scan does not read.
    """
    rows = take(docs, id=doc_id, text=text)
    schema = T.StructType(T._parse_datatype_string(BLOCKS).fields + [
        T.StructField("first", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    kind = np.dtype(f"<u{width}")
    arrow = to_arrow_schema(schema)
    size = block_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = f"part-{TaskContext.get().partitionId():06d}"
        block = first = 0
        buffer, ids = bytearray(), []
        closes: list[int] = []  # where the documents in ids end, in bytes from the start of the buffer

        def flush(whole: bool):
            nonlocal buffer, ids, closes, block, first
            out = []
            while len(buffer) >= size or (whole and buffer):
                n = sum(1 for c in closes if c <= size)
                out.append((file, block, bytes(buffer[:size]), first, ids[:n]))
                block, first = block + 1, first + n
                buffer, ids, closes = buffer[size:], ids[n:], [c - size for c in closes[n:]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=schema.names)

        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            keys = batch.column("id").to_pylist()
            for at in range(0, len(keys), 64):
                for key, tokens in zip(keys[at:at + 64], encode(batch.column("text").slice(at, 64).to_pylist())):
                    buffer += tokens.astype(kind).tobytes() + end
                    ids.append(key)
                    closes.append(len(buffer))
                yield from flush(False)
        yield from flush(True)

    return materialize(rows.mapInArrow(run, schema), "token-stream")


def read_flat_files(spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of flat token files in any file system that Spark reads.

    A file is read by one task and cut into blocks there; larger stores keep their files at a few hundred MB.
    """
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", "content", "length").where("length > 0")
    return files.select(
        F.col("path").alias("file"), "content",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"),
    ).select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("tokens"))


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """(file, block, size, n_end, first_end, last_end, inner): of each block, its tokens, its separators, where the first
    and the last of them stand, and the tokens between each two neighbours.
    """
    kind = np.dtype(f"<u{width}")
    schema = T._parse_datatype_string(
        "file string, block long, size long, n_end long, first_end long, last_end long, inner array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found = [], []
            for raw in batch.column("tokens"):
                data = raw.as_buffer() if raw.is_valid else b""
                if len(data) % width:
                    raise ValueError(f"a token file ends inside a token of {width} bytes")
                ids = np.frombuffer(data, kind)
                size.append(len(ids))
                found.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([
                batch.column("file"), batch.column("block"), pa.array(size, pa.int64()),
                pa.array([len(at) for at in found], pa.int64()),
                pa.array([at[0] if len(at) else None for at in found], pa.int64()),
                pa.array([at[-1] if len(at) else None for at in found], pa.int64()),
                pa.array([np.diff(at) - 1 for at in found], pa.list_(pa.int64()))], names=schema.names)

    return blocks.select("file", "block", "tokens").mapInArrow(run, schema)


def prefix_scan(rows: DataFrame, keys: list[str], order: str, last: str, prefix: str) -> DataFrame:
    """Add what comes before each row: tokens ``start``, separators ``ended``, place of the last separator ``seen``."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    return (
        rows.withColumn(f"{prefix}start", start)
        .withColumn(f"{prefix}ended", F.coalesce(F.sum("n_end").over(before), F.lit(0)))
        .withColumn(f"{prefix}seen", F.max(F.col(f"{prefix}start") + F.col(last)).over(before))
    )


def documents_in(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(file, ordinal, n_tokens, closed): a row for each document of each file, in file order from 0.

    Two separators in a row are an empty document. Tokens after the last separator of a file are a document that is not
    ``closed``. An empty file has no documents; a null block counts as an empty one. Blocks may come in any order
    and be of any size, but each (file, block) must come once.
    """
    marks = materialize(scan_blocks(blocks, end_id, width), "separators")
    marks = marks.withColumn("group", F.floor(F.col("block") / group_blocks))
    inside = prefix_scan(marks, ["file", "group"], "block", "last_end", "")
    groups = inside.groupBy("file", "group").agg(
        F.sum("size").alias("size"), F.sum("n_end").alias("n_end"), F.max(F.col("start") + F.col("last_end")).alias("last_end"))
    groups = prefix_scan(groups, ["file"], "group", "last_end", "g_")
    stitched = inside.where("n_end > 0").join(groups.select("file", "group", "g_start", "g_ended", "g_seen"), ["file", "group"])
    seen = F.coalesce(F.col("g_start") + F.col("seen"), F.col("g_seen"), F.lit(-1))
    first = F.col("g_start") + F.col("start") + F.col("first_end") - seen - 1
    closed = stitched.select(
        "file", (F.col("g_ended") + F.col("ended")).alias("ordinal"), F.posexplode(F.concat(F.array(first), "inner")).alias("k", "n_tokens"),
    ).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    rest = groups.groupBy("file").agg(
        F.sum("n_end").alias("ordinal"),
        (F.sum("size") - 1 - F.coalesce(F.max(F.col("g_start") + F.col("last_end")), F.lit(-1))).alias("n_tokens"),
    ).where("n_tokens > 0").withColumn("closed", F.lit(False))
    return closed.unionByName(rest)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document in the byte-level vocabulary, counted from the flat token files."""
    stream = write_token_stream(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counted = documents_in(stream)
    written = stream.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return written.join(counted, ["file", "ordinal"], "full").select("doc_id", "n_tokens")


OP5_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_tokens FROM documents"
