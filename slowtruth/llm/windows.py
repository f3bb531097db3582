"""Substring dedup by words: level-wise doubling of repeated windows.

A window of ``window`` words can only be repeated if every shorter window in it is. So windows are counted at one short
length first; those repeated there, and only those, are extended to twice that length, and so on up to ``window``,
until no candidates survive (35 words: 9, 18, 35; the last step is cut short).

1. Texts are put beside their near copies (ranges of their lowest short window) and written once in packs of a few MB.
2. A level hashes the candidates of each pack. Below the full length a candidate stands for itself by the lowest short
   window in it, so that one of about ten positions is counted: equal windows have equal lowest ones. Distinct hashes go,
   sorted, to the bucket of their range; the bucket finds those that stand twice, in one pack or in two, and answers each
   pack with one bit for each hash it sent.
3. A pack meets its answers, which are all it needs to know which of its windows are candidates of the next level. It is
   compressed, so that this is cheaper than hashes kept for each word.
4. After the last level the candidates are the repeated windows, and their words go.

A passage in very many texts is one hash for each pack, whatever the number of texts. Short levels use 64 bits, where a
collision costs a candidate at worst; the full length uses 96.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtruth.llm.common import map_batches, numbered, position, restored
from slowtruth.llm.packs import opened, packs, texts_of
from slowtruth.llm.rolling import Ranges, combined, sliding
from slowtruth.session import materialize

WINDOW, SHORTEST = 35, 9
#: Text of a pack, and hashes of a bucket, for the number of buckets.
PACK_BYTES, BUCKET_HASHES = 2 << 20, 2_000_000
_ONE_SPACE = bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))


def lengths(window: int, shortest: int) -> list[int]:
    """Window lengths of the levels, ascending: each is at most twice the one before."""
    out = [window]
    while out[-1] > shortest:
        out.append(-(-out[-1] // 2))
    return out[::-1]


class Words:
    """The words of some texts, one after another; text ``k`` has those from ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer((b" ".join([*texts, b""]) + b" ").translate(_ONE_SPACE), np.uint8)
        word = joined != 32
        before = np.concatenate(([False], word[:-1]))
        begins = np.flatnonzero(word & ~before)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(begins, offsets)
        self.data = joined[word | before]  # each word and one space
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)).astype(np.int64)[: len(self.ends)]
        self.n = len(self.ends)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word."""
        if seed in self._hashes:
            return self._hashes[seed]
        out = self._hashes[seed] = np.zeros(self.n, np.uint64)
        step = 1 << 17
        for lo in range(0, self.n, step):  # about a megabyte of text at a time
            starts, ends = self.starts[lo : lo + step], self.ends[lo : lo + step]
            near = Ranges(self.data[starts[0] : ends[-1]], seed)
            out[lo : lo + step] = near.hashes(starts - starts[0], ends - starts[0])
        return out

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        """A hash of ``length`` words from each word on, by doubling; the last ``length - 1`` have none."""
        total = max(0, self.n - length + 1)
        level, sizes, size = self.hashes(seed), {}, 1
        while True:
            sizes[size] = level
            if size * 2 > length:
                break
            level = combined(level[:-size], level[size:]) if len(level) > size else level[:0]
            size *= 2
        out, offset = None, 0
        for size in sorted((s for s in sizes if s & length), reverse=True):
            piece = sizes[size][offset : offset + total]
            out = piece if out is None else combined(out[:total], piece)
            offset += size
        return out[:total]

    def inside(self, length: int) -> np.ndarray:
        """Where a window of ``length`` words begins that does not leave its text."""
        if self.n < length:
            return np.zeros(0, np.int64)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n)
        return np.flatnonzero(left >= length)


def candidates(words: Words, at: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a level counts for the windows that begin ``at``: (a, b, twice, own).

    ``a`` and ``b`` are the distinct hashes in order, ``twice`` whether they stand at two places, ``own`` the number of
    each window's hash. Below the full length ``b`` is zero.
    """
    if not len(at):
        none = np.zeros(0, np.uint64)
        return none, none.astype(np.uint32), none.astype(bool), none.astype(np.int64)
    h = words.windows(length)
    if length < window:
        span = window - length + 1
        low = np.zeros(len(h) - span + 1, np.uint64)
        h |= np.uint64(1)  # zero stands for no candidate
        low[at] = sliding(h, span, np.minimum)[at]
        pad = np.zeros(span - 1, np.uint64)
        places = h[sliding(np.concatenate((pad, low, pad)), span, np.maximum) == h]
        a, count = np.unique(places, return_counts=True)
        return a, np.zeros(len(a), np.uint32), count > 1, np.searchsorted(a, low[at])
    a, b = h[at], (words.windows(length, 1)[at] >> np.uint64(32)).astype(np.uint32)
    order, new = grouped(a, b)
    own = np.empty(len(at), np.int64)
    own[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return a[order][first], b[order][first], np.diff(np.concatenate((first, [len(at)]))) > 1, own


def grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, ascending, and where a new pair begins in it."""
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if np.any(same & (b[order][1:] != b[order][:-1])):
        order = np.lexsort((b, a))
        same = a[order][1:] == a[order][:-1]
    return order, np.concatenate(([True], ~(same & (b[order][1:] == b[order][:-1]))))[: len(a)]


def survivors(words: Words, answers: list[tuple], levels: list[int], window: int) -> np.ndarray:
    """Where the windows begin that every answered level found repeated; ``answers`` are (level, bucket, bits)."""
    at = words.inside(window)
    known: dict[int, list] = {}
    for level, bucket, bits, size in answers:
        known.setdefault(level, []).append((bucket, bits, size))
    for level in sorted(known):
        a, _, _, own = candidates(words, at, levels[level], window)
        told = [np.unpackbits(np.frombuffer(bits, np.uint8), count=size) for _, bits, size in sorted(known[level])]
        if len(a):
            at = at[np.concatenate(told).astype(bool)[own]]
    return at


def sent(told: DataFrame, level: int, levels: list[int], window: int, text: str, buckets: int) -> DataFrame:
    """(bucket, pack, a, b, twice, n): the sorted hashes that a level counts, from (pack, blob, answers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob, answers in zip(*(batch.column(c) for c in ("pack", "blob", "answers"))):
                words = Words(texts_of(opened(blob.as_py()), text))
                at = survivors(words, [tuple(x.values()) for x in answers.as_py() or ()], levels, window)
                a, b, twice, _ = candidates(words, at, levels[level], window)
                bucket = ((a >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(a) else np.zeros(1, np.int64)
                pairs = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[cuts[:-1]], pa.int64()), "pack": pa.array([pack.as_py()] * len(pairs), pa.int64()),
                    "a": pa.array([a[p:q].tobytes() for p, q in pairs], pa.binary()),
                    "b": pa.array([b[p:q].tobytes() if b[p:q].any() else None for p, q in pairs], pa.binary()),
                    "twice": pa.array([np.packbits(twice[p:q]).tobytes() for p, q in pairs], pa.binary()),
                    "n": pa.array([q - p for p, q in pairs], pa.int32())})

    return told.mapInArrow(run, "bucket long, pack long, a binary, b binary, twice binary, n int")


def answered(entries: DataFrame, level: int) -> DataFrame:
    """(pack, level, bucket, bits, size, repeated): for each hash that a pack sent, whether it stands anywhere else."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_numpy()
        a = np.frombuffer(b"".join(table["a"].to_pylist()), np.uint64)
        b = np.concatenate([np.zeros(n, np.uint32) if x is None else np.frombuffer(x, np.uint32) for x, n in zip(table["b"].to_pylist(), sizes)])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes)]).astype(bool)
        order, new = grouped(a, b)
        group = np.cumsum(new) - 1
        several = np.bincount(group) > 1
        several[group[twice[order]]] = True
        out = np.empty(len(a), bool)
        out[order] = several[group]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        parts = [out[p:q] for p, q in zip(cuts[:-1], cuts[1:])]
        return pa.table({
            "pack": table["pack"], "level": pa.array([level] * len(parts), pa.int32()), "bucket": table["bucket"],
            "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()), "size": table["n"],
            "repeated": pa.array([int(p.sum()) for p in parts], pa.int64())})

    return entries.groupBy("bucket").applyInArrow(run, "pack long, level int, bucket long, bits binary, size int, repeated long")


def drop_repeated_words(docs: DataFrame, text: str = "text", window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """All rows of ``docs`` with their text without repeated words, ``n_words`` before, ``n_removed`` and ``spans``.

    Words are runs of anything but ASCII white space. A word goes if a window of ``window`` words that covers it also
    begins anywhere else, in the same text or in another one; windows are judged on the input. Kept words are joined by
    one space; ``spans`` are the maximal runs of removed words (start and length, in words).

    A null text has no words and comes back empty, as an empty one does; texts of fewer words than the window lose
    nothing. Every row is a text: rows that are repeated lose all their windows, in each of them. Null ids and other
    columns are carried along untouched. An empty table gives an empty table. A text of any length stays in one pack.
    """
    names = docs.columns
    text_at = f"_{position(docs, text)}"
    levels = lengths(window, shortest)

    def lowest(texts: list) -> list[list]:
        words = Words([(t or "").encode("utf-8", "replace") for t in texts])
        h = words.windows(levels[0]) >> np.uint64(1)
        out = np.full(len(texts), -1, np.int64)
        inside = words.inside(levels[0])
        if len(inside):
            owner = np.searchsorted(words.first, inside, "right") - 1
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[first]] = np.minimum.reduceat(h[inside], first)
        return [out.tolist()]

    spread = ["low", F.xxhash64(text_at), F.xxhash64(*[f"_{i}" for i in range(len(names))])] if names else []
    near = map_batches(numbered(docs), [text_at], lowest, [("low", "long")])
    near = near.repartitionByRange(*spread).sortWithinPartitions("low", F.xxhash64(text_at))
    rows = near.drop("low")
    held = materialize(packs(rows, text_at, PACK_BYTES), "packs", compression="uncompressed")
    total = held.agg(F.sum("size")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers: list[DataFrame] = []

    def told() -> DataFrame:
        if not answers:
            return held.withColumn("answers", F.lit(None).cast("array<struct<level:int,bucket:long,bits:binary,size:int>>"))
        all_ = answers[0]
        for more in answers[1:]:
            all_ = all_.unionByName(more)
        own = all_.groupBy("pack").agg(F.collect_list(F.struct("level", "bucket", "bits", "size")).alias("answers"))
        return held.join(own.hint("merge"), "pack", "left")  # the same plan at every size

    for level, length in enumerate(levels):
        share = 1 if length == window else 2 / (window - length + 2)
        buckets = max(least, int(total / 6 * share // BUCKET_HASHES) + 1)
        answers.append(materialize(answered(sent(told(), level, levels, window, text_at, buckets), level), "answers"))
        if not answers[-1].agg(F.sum("repeated")).first()[0]:
            break  # no candidates survive

    schema = T.StructType(rows.schema.fields + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T._parse_datatype_string("array<struct<start:long,length:long>>"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = rows_names.index(text_at)
        for batch in batches:
            for blob, known in zip(batch.column("blob"), batch.column("answers")):
                inner = opened(blob.as_py())
                words = Words(texts_of(inner, text_at))
                gone = np.zeros(words.n + 1, np.int64)
                at = survivors(words, [tuple(x.values()) for x in known.as_py() or ()], levels, window)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                lost = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], lost, [False])).astype(np.int8)))
                edges = np.unique(np.concatenate((edges, words.first[(words.first > 0) & (words.first < words.n)])))
                runs = [(p, q) for p, q in zip(edges[:-1], edges[1:]) if lost[p]] if len(edges) else []
                kept, spans = [], [[] for _ in range(inner.num_rows)]
                for p, q in runs:
                    k = int(np.searchsorted(words.first, p, "right")) - 1
                    spans[k].append({"start": int(p - words.first[k]), "length": int(q - p)})
                whole = words.data.tobytes()
                for k in range(inner.num_rows):
                    p, q = int(words.first[k]), int(words.first[k + 1])
                    pieces, here = [], p
                    for span in [*spans[k], {"start": q - p, "length": 0}]:
                        stop = p + span["start"]
                        if stop > here:
                            pieces.append(whole[words.starts[here] : words.ends[stop - 1]])
                        here = stop + span["length"]
                    kept.append(b" ".join(pieces).decode("utf-8", "replace"))
                count = np.diff(words.first)
                removed = [sum(s["length"] for s in x) for x in spans]
                arrays = list(inner.columns)
                arrays[where] = pa.array(kept, arrays[where].type)
                yield pa.RecordBatch.from_arrays([
                    *arrays, pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=out_names)

    rows_names, out_names = rows.columns, schema.names
    return restored(told().mapInArrow(cut, schema), names, ["n_words", "n_removed", "spans"])


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every whole document in 35 words that stand anywhere else too, and the hash of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_words(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
     p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
     s AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM p WHERE i + {WINDOW - 1} <= len(words)),
     r AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
     m AS (SELECT p.doc_id, p.i, p.words[p.i] AS word, coalesce(max(CASE WHEN r.h IS NOT NULL THEN 1 ELSE 0 END) OVER (
                  PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) AS gone
           FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.i = p.i LEFT JOIN r ON r.h = s.h),
     g AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
                  coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
