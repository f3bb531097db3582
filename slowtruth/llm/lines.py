"""Line dedup: lines that many documents share go, except in the last document that holds them.

Each document's lines are exploded to (document, line hash, positions), the documents of each hash are
counted, and the positions of lines over the threshold travel back to their document, where the text is
put together again without them. Texts cross the network once, for that last join; before it only hashes
move, one for each distinct line of a document.

A line that a third of all documents hold is one hash with as many rows. It is counted by partial
aggregation, and the join that returns its positions is one of two stored tables, which Spark's skew
handling can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtruth.llm.common import ascii_lower_sql, map_batches, numbered, position, restored
from slowtruth.session import materialize

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_keys(text: str | None) -> list[bytes]:
    """Of each line: stripped of ASCII white space, A-Z lower-cased, as UTF-8."""
    return [line.strip().lower() for line in (text or "").encode("utf-8", "replace").split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def exploded_lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, version, key, positions): a row for each distinct long line of a row of (id, version, text)."""
    id_field = docs.schema["id"]
    schema = T.StructType([
        id_field, T.StructField("version", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows, keys, places = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own: dict[bytes, list[int]] = {}
                for i, key in enumerate(line_keys(text)):
                    if long_enough(key, least):
                        own.setdefault(key, []).append(i)
                rows += [row] * len(own)
                keys += [xxhash.xxh3_128_digest(key) for key in own]
                places += own.values()
            which = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(which), batch.column("version").take(which), pa.array(keys, pa.binary()),
                 pa.array(places, pa.list_(pa.int32()))], names=["id", "version", "key", "positions"])

    return docs.mapInArrow(run, schema)


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                      min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All rows of ``docs`` with their text without shared lines, ``n_lines`` before and ``n_dropped``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_documents`` documents lose all their lines, except in the largest id holding them.

    A null or empty text is one empty line and comes back empty. Rows with the same id are one document: they count
    once, and the largest id keeps its lines in all of them. Null ids are together one document, below all others.
    An empty table gives an empty table. Lines are compared by a 128-bit hash of their keys.
    """
    names = docs.columns
    id_at, text_at = f"_{position(docs, doc_id)}", f"_{position(docs, text)}"
    plain = numbered(docs).withColumn("version", F.xxhash64(text_at))
    lines = materialize(
        exploded_lines(plain.select(F.col(id_at).alias("id"), "version", F.col(text_at).alias("text")), min_chars), "lines")
    # rows of one id count once: without repeated ids the distinct is a second look at small rows
    held = lines.select("id", "key").groupBy("key", "id").agg(F.lit(1).alias("one"))
    shared = materialize(
        held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_documents).select("key", "last"), "shared-lines")
    gone = (
        lines.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id", "version").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("gone"))
        .withColumnsRenamed({"id": "gone_id", "version": "gone_version"})
    )
    joined = plain.join(
        gone, plain[id_at].eqNullSafe(gone.gone_id) & (plain.version == gone.gone_version), "left"
    ).drop("gone_id", "gone_version", "version")

    def rebuild(texts: list, dropped: list) -> list[list]:
        kept, total, less = [], [], []
        for text_, out in zip(texts, dropped):
            lines_ = (text_ or "").split("\n")
            total.append(len(lines_))
            less.append(len(out or ()))
            if out:
                out = set(out)
                text_ = "\n".join(x for i, x in enumerate(lines_) if i not in out)
            kept.append(text_ or "")
        return [kept, total, less]

    new = [("kept_text", "string"), ("n_lines", "long"), ("n_dropped", "long")]
    out = map_batches(joined, [text_at, "gone"], rebuild, new).drop("gone")
    return restored(
        out.drop(text_at).withColumnRenamed("kept_text", text_at), names, ["n_lines", "n_dropped"])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines lost by every whole document, and the hash of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_shared_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP1_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
     k AS (SELECT doc_id, pos, line, {ascii_lower_sql(_STRIP.format('line'))} AS key FROM l),
     s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS}
           GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
     m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
