"""MinHash near-dedup with bottom-k sketches from one hash function.

A text's sketch are the k smallest hashes of its five-word shingles. Equal shingle sets are one class from the
start, represented by one row. Inverted lists of retained values then say which classes may be similar: two sets
of the wanted similarity share at least half of a sketch (``MIN_ESTIMATE``, see there), so each class needs to be
listed only under its rarest retained values, half of them and one. Classes connected by lists form clusters; a
cluster's sketches and full sets meet in one task, or, beyond a size bound, in a grid of tasks. There the
lists give the overlaps, the sketch of the union estimates the similarity, and the full sets decide. A task returns
no more links than its classes need to be connected, so copies are never expanded into pairs.

What is common (a passage of ten thousand documents) is last in the order of rarity, and so lists nothing unless
it makes up half of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtruth.llm.common import numbered, parts_of, position, restored
from slowtruth.llm.graph import components
from slowtruth.session import materialize

SHINGLE, PERCENT, K = 5, 85, 64
#: Pairs whose union sketch agrees in less than this share are given up. For a pair of similarity 0.85 and k = 64 this
#: happens with a probability of about 1e-10, for 0.8 of about 1e-8; sets of up to k shingles are never given up.
MIN_ESTIMATE = 0.5
#: A task of a large cluster compares at most so many classes, or shingles, of two chunks.
CHUNK_SETS, CHUNK_SHINGLES = 2000, 2_000_000
#: Tables of up to so many rows of one or two numbers are sent to all tasks; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words whose hash a task keeps: about 200 bytes each, held by every Python worker of an executor.
KEPT_WORDS = 200_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
PAD = np.iinfo(np.int64).max


class WordHashes(dict):
    """Word -> 64-bit hash, computed once for each word as long as the table is small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (int64) of the word shingles; of fewer words, one for the whole sequence; of none, none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n, k = len(words), min(len(words), size)
    if not n:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    h = codes[: n - k + 1].copy()
    for i in range(1, k):
        h *= PRIME
        h += codes[i : n - k + 1 + i]
    h += np.uint64(k)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    h = h.view(np.int64)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def list_array(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow list<int64> from arrays, without Python objects."""
    ends = np.cumsum([0, *[len(a) for a in arrays]]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(rows: DataFrame, k: int, size: int) -> DataFrame:
    """(row, n, digest, sketch) from (row, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in parts_of(batches):
            n, digest, low = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes, size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                low.append(s[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), list_array(low)],
                names=["row", "n", "digest", "sketch"])

    return rows.mapInArrow(run, "row long, n long, digest binary, sketch array<long>")


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """(row, set) from (row, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts_of(batches):
            sets = [shingle_set(t, hashes, size) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), list_array(sets)], names=["row", "set"])

    return rows.mapInArrow(run, "row long, set array<long>")


def listed(classes: DataFrame, least: float) -> DataFrame:
    """(row, value): the retained values each class is listed under, where at least one more class may be.

    Rarest first, ``least`` of the sketch can be left out less one: two sketches that share that many values share one of
    the listed ones, whatever the order. Values that no other class retains come first and list nothing.
    """
    values = classes.select("row", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    shared = materialize(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "values")
    per = values.join(shared, "value").groupBy("row").agg(
        F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    length = F.size("v") - F.ceil(F.col("s") * least).cast("int") + 1
    return per.where(length > 0).select("row", F.explode(F.slice("v", F.lit(1), length)).alias("x")).select("row", "x.value")


def union_estimates(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Share of the k smallest values of each union that both sketches hold; rows are padded sketches."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != PAD
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twice, axis=1)
    return (twice & (rank <= k)).sum(axis=1) / np.maximum(np.minimum(rank[:, -1], k), 1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    total = int(lengths.sum())
    offsets = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + offsets


def spanning_links(sketch_ends, sketch_values, set_ends, set_values, labels: np.ndarray, side: np.ndarray,
                   k: int, percent: int, least: float) -> list[tuple[int, int]]:
    """Links that connect everything that verified links connect, among the given sets.

    ``labels``: sets with the same label are connected already. ``side``: 0 compares with all, else only sets of
    different sides are compared.
    """
    m = len(sketch_ends) - 1
    s, n = np.diff(sketch_ends), np.diff(set_ends)
    labels = np.unique(labels, return_inverse=True)[1]
    padded = np.full((m, k), PAD, np.int64)
    padded[np.repeat(np.arange(m), s), ranges(np.zeros(m, np.int64), s)] = sketch_values
    # inverted lists of the retained values
    own = np.repeat(np.arange(m), s)
    order = np.argsort(sketch_values, kind="stable")
    vals, holders = sketch_values[order], own[order]
    first = np.searchsorted(vals, sketch_values, "left")
    tokens = np.unique(set_values, return_inverse=True)[1]
    mark = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, bool)
    place = np.empty(len(vals), np.int64)
    place[order] = np.arange(len(vals))
    links = []
    for a in range(1, m):
        lo, hi = sketch_ends[a], sketch_ends[a + 1]
        # earlier sets in the lists of a's values: holders are in order inside a list, so they end where a stands
        count = np.bincount(holders[ranges(first[lo:hi], place[lo:hi] - first[lo:hi])], minlength=a)[:a]
        near = np.flatnonzero(count >= np.maximum(1, np.ceil(least * np.maximum(s[:a], s[a]) - 1e-9)))
        near = near[(labels[near] != labels[a]) & ((side[near] == 0) | (side[near] != side[a]))]
        near = near[100 * np.minimum(n[near], n[a]) >= percent * np.maximum(n[near], n[a])]
        if not len(near):
            continue
        near = near[union_estimates(padded[near], np.broadcast_to(padded[a], (len(near), k)), k) >= least]
        if not len(near):
            continue
        mine = tokens[set_ends[a] : set_ends[a + 1]]
        mark[mine] = True
        hit = mark[tokens[ranges(set_ends[near], n[near])]]
        common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(n[near])[:-1])))
        mark[mine] = False
        for b in near[100 * common >= percent * (n[near] + n[a] - common)]:
            if labels[b] != labels[a]:
                links.append((a, int(b)))
                labels[labels == labels[b]] = labels[a]
    return links


def verified(tasks: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """(a, b): links found in each task of (cluster, i, j, side, row, label, sketch, set)."""
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["row"].to_numpy(), table["set"].combine_chunks().value_lengths().to_numpy()))
        table = table.take(pa.array(order))
        low, full = table["sketch"].combine_chunks(), table["set"].combine_chunks()
        ends = lambda x: np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy().astype(np.int64))))
        links = spanning_links(
            ends(low), low.flatten().to_numpy(), ends(full), full.flatten().to_numpy(),
            table["label"].to_numpy(), table["side"].to_numpy(), k, percent, least)
        rows = table["row"].to_numpy()
        return pa.table({"a": pa.array([rows[x] for x, _ in links], pa.int64()), "b": pa.array([rows[y] for _, y in links], pa.int64())})

    return tasks.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def few(rows: DataFrame) -> DataFrame:
    """Broadcast if small enough, so that texts and sketches are not shuffled to find a few of them. Same result."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                    k: int = K, least: float = MIN_ESTIMATE, chunk_sets: int = CHUNK_SETS,
                    chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """All rows of ``docs`` with ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept``.

    Two texts are linked if ``100 * intersection >= percent * union`` of their sets of distinct shingles of ``size`` words
    (A-Z lower-cased, words split at ASCII white space); a text of fewer words is one shingle. ``kept`` marks one row of
    each component: the smallest id, of several rows with that id the first written.

    Null and empty texts, and those without words, have an empty set and are linked with nothing. Null ids come after
    all others; a component of null ids has a null ``component_id``. Rows with one id are separate nodes. An empty table
    gives an empty table. Shingles are compared by 64-bit hashes.
    """
    names = docs.columns
    id_at, text_at = f"_{position(docs, doc_id)}", f"_{position(docs, text)}"
    rows = materialize(numbered(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    texts = rows.select("row", F.col(text_at).alias("text"))
    drawn = materialize(sketches(texts, k, size), "sketches")
    # equal sets are one class; its representative is its first row
    firsts = materialize(drawn.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("class")), "classes")
    member = materialize(
        drawn.where("n > 0").select("row", "digest", "n").join(firsts, ["digest", "n"]).select("row", "class"), "members")
    classes = materialize(
        drawn.join(firsts.select(F.col("class").alias("row")), "row", "left_semi").select("row", "n", "sketch"), "class-sketches")
    lists = materialize(listed(classes, least), "lists")
    heads = materialize(
        lists.groupBy("value").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").select("value", "head"),
        "heads")
    clusters = components(lists.join(heads, "value").select("row", "head"), "row", "head")
    inside = materialize(
        classes.join(few(clusters.select(F.col("node").alias("row"), F.col("root").alias("cluster"))), "row"), "clusters")
    # a cluster beyond the bound is cut into chunks, compared within themselves first, then with each other
    cut = inside.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / chunk_sets), F.ceil(F.sum("n") / chunk_shingles)).cast("int").alias("chunks"))
    cut = materialize(cut, "chunks")
    sets = full_sets(texts.join(few(inside.select("row")), "row", "left_semi"), size)
    work = materialize(
        inside.join(cut, "cluster").join(sets, "row")
        .withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")), "sets")
    own = work.select("cluster", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.lit(0).alias("side"), "row",
                      F.col("row").alias("label"), "sketch", "set")
    links = materialize(verified(own, k, percent, least), "links")
    if cut.where("chunks > 1").limit(1).count():
        known = components(links, "a", "b")
        grid = work.where("chunks > 1").join(known, work.row == known.node, "left").withColumn("label", F.coalesce("root", "row"))
        grid = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk").select(
            "cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
            F.when(F.col("chunk") < F.col("other"), 1).otherwise(2).alias("side"), "row", "label", "sketch", "set")
        links = links.unionByName(materialize(verified(grid, k, percent, least), "links"))
    joined = components(links, "a", "b")
    # from rows to classes to components; then the smallest id of each
    ids = rows.select("row", F.col(id_at).alias("id")).join(drawn.select("row", "n"), "row").join(member, "row", "left")
    rooted = materialize(
        ids.join(joined.withColumnRenamed("node", "class"), "class", "left")
        .select("row", "id", "n", F.coalesce("root", "class", "row").alias("root")), "rooted")
    least_id = materialize(rooted.groupBy("root").agg(
        F.min("id").alias("component_id"),
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))["row"].alias("keeper")), "keepers")
    result = rooted.join(least_id, "root").select(
        "row", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("keeper")).alias("kept"))
    return restored(rows.join(result, "row"), names, ["n_shingles", "component_id", "kept"])


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


_W = f"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+')"""
#: Exact links by counting common shingles; fits small tables only, where the check runs it.
OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + {SHINGLE - 1}), ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS p FROM d WHERE len(w) > 0)),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS MATERIALIZED (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
           WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
     r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON r.reach = l.x),
     m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON d.doc_id = m.node LEFT JOIN n ON d.doc_id = n.doc_id
"""
