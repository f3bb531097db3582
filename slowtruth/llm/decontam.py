"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of test items.

Items become windows of ten consecutive words. All windows go into one automaton, which reads every
normalised document once, in time that does not depend on the number of windows. Hits are kept as word
numbers and, on request, mapped back to character offsets of the original text.

The benchmark is the stated query set. Its windows are collected in blocks of at most ``block_bytes`` of
pattern text, so what is sent to the tasks has a fixed bound; each further block is one more pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtruth.llm.common import LOWER, UPPER, numbered, parts_of, position, restored, take, to_arrow_schema

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: Bytes that are no part of a word become a space, A-Z become a-z; bytes of other alphabets stay.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = "array<struct<first_word:long,last_word:long,start:long,end:long>>"
FIELDS = [
    ("n_words", "long"), ("n_hit", "long"), ("spans", SPAN), ("items", "array<string>"), ("n_items", "long"),
    ("contaminated", "boolean"),
]


def fold(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items and the ids of the items that hold each.

    An item of fewer words is one window; one without words has none. Items with a null id count as
    the id ``null``.
    """
    words = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    items = take(benchmark, item=item_id, text=text).select(
        F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"),
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(words), F.lit(0)).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    windows = F.transform(starts, lambda s: F.array_join(F.slice("w", s, window), " "))
    return (
        items.select("item", F.explode(F.array_distinct(windows)).alias("window"))
        .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def blocks_of(windows: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[str, list[str]]], bool]]:
    """The windows, in lists of at most about ``block_bytes``, and whether a list is the last one."""
    cost = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x)) + 64
    total = windows.agg(F.sum(cost)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = windows if n == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        yield [(r["window"], r["items"]) for r in part.collect()], k == n - 1


def scan(shared: Broadcast, column: str, k: int) -> Step:
    """A step that appends the hits of block ``k`` to all rows: (first word, last word) pairs and item ids."""
    pairs, ids = pa.list_(pa.int64()), pa.list_(pa.string())
    added = [f"count{k}", f"hits{k}", f"found{k}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for window, items in shared.value:
            # one character for each byte: compact strings; the spaces are the borders of words
            automaton.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, items))
        ready = bool(shared.value)
        if ready:
            automaton.make_automaton()
        for batch in parts_of(batches):
            counts, hits, found = [], [], []
            for text in batch.column(column).to_pylist():
                words = fold(text)
                counts.append(len(words))
                spans, items, at, seen = [], set(), 0, 0
                if ready and words:
                    line = b" " + b" ".join(words) + b" "
                    for end, (size, holders) in automaton.iter(line.decode("latin-1")):
                        seen += line.count(b" ", at, end)  # spaces before the last one of the hit = words up to its end
                        at = end
                        first = seen - size
                        if spans and first <= spans[-1] + 1 and spans[-2] <= first:
                            spans[-1] = max(spans[-1], seen - 1)
                        else:
                            spans += [first, seen - 1]
                        items.update(holders)
                hits.append(spans)
                found.append(sorted(items))
            new = [pa.array(counts, pa.int64()), pa.array(hits, pairs), pa.array(found, ids)]
            yield pa.RecordBatch.from_arrays(batch.columns + new, names=batch.schema.names + added)

    return run


def merged(numbers: list[int]) -> list[tuple[int, int]]:
    """Pairs of word numbers as sorted runs without overlap; runs that touch become one."""
    out: list[list[int]] = []
    for first, last in sorted(zip(numbers[::2], numbers[1::2])):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def finish(keep: list[str], column: str, n_blocks: int) -> Step:
    """A step that turns the hits of all blocks into the columns of ``FIELDS``."""
    kinds = to_arrow_schema(T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in FIELDS])).types
    names = keep + [n for n, _ in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(zip(*[batch.column(f"hits{k}").to_pylist() for k in range(n_blocks)]))
            found = list(zip(*[batch.column(f"found{k}").to_pylist() for k in range(n_blocks)]))
            original = batch.column(column)
            spans, items = [], []
            for row, (numbers, ids) in enumerate(zip(hits, found)):
                runs = merged([x for block in numbers for x in block])
                if runs:
                    where = [m.span() for m in WORD.finditer(original[row].as_py())]
                    runs = [{"first_word": a, "last_word": b, "start": where[a][0], "end": where[b][1]} for a, b in runs]
                spans.append(runs)
                items.append(sorted({x for block in ids for x in block}))
            n_hit = [sum(r["last_word"] - r["first_word"] + 1 for r in runs) for runs in spans]
            new = [batch.column("count0"), n_hit, spans, items, [len(x) for x in items], [n > 0 for n in n_hit]]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + arrays, names=names)

    return run


def then(first: Step, second: Step) -> Step:
    """Both steps in one worker."""
    return lambda batches: second(first(batches))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``docs`` with what they share with the benchmark.

    ``n_words`` and ``n_hit`` (words inside an occurrence of a window), ``spans`` (maximal runs of such words: first
    and last word, start and end character of the original text, end exclusive), ``items`` (ids as strings, sorted),
    ``n_items``, ``contaminated`` (a word is hit).

    Null and empty texts have no words and no hits. An empty benchmark hits nothing. Rows are judged one by one, so
    repeated rows get equal results. Windows that several items share name all of them.
    """
    at = position(docs, text)
    out = numbered(docs)
    keep, kept = out.columns, out.schema.fields
    schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in FIELDS])
    for k, (block, last) in enumerate(blocks_of(item_windows(benchmark, item_id, item_text, window), block_bytes)):
        run = scan(docs.sparkSession.sparkContext.broadcast(block), f"_{at}", k)
        if last:  # in the worker that finds the last hits, so that the texts travel once less
            out = out.mapInArrow(then(run, finish(keep, f"_{at}", k + 1)), schema)
        else:
            hits = T._parse_datatype_string(f"count{k} long, hits{k} array<long>, found{k} array<string>")
            out = out.mapInArrow(run, T.StructType(out.schema.fields + hits.fields))
    return restored(out, docs.columns, [n for n, _ in FIELDS])


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every whole document that lie in a window of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(
    u=UPPER, l=LOWER)
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
     iw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size,
                   array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS s FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM iw),
     dw AS (SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
     hits AS (SELECT doc_id, s, dw.size, item FROM dw JOIN iw USING (win) WHERE dw.size = iw.size),
     words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY 1),
     items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
               FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
