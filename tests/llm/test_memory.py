"""What a Python worker holds at once."""

from slowtruth.llm import common, decontam, neardup


def test_texts_are_opened_in_slices(spark):
    """A batch of many texts is never a list of Python objects as a whole."""
    docs = spark.createDataFrame([(i, "word " * 3) for i in range(1000)], "i long, text string").coalesce(1)
    sizes = common.map_batches(docs, ["text"], lambda texts: [[len(texts)] * len(texts)], [("n", "long")])
    found = sizes.collect()
    assert len(found) == 1000 and max(r["n"] for r in found) <= common.PART_ROWS


def test_kept_word_hashes_are_bounded():
    hashes = neardup.WordHashes()
    first = hashes[b"0"]
    for i in range(neardup.KEPT_WORDS + 5):
        hashes[str(i).encode()]
    assert len(hashes) <= neardup.KEPT_WORDS + 1 < 300_000
    assert hashes[b"0"] == first


def test_benchmark_hits_are_found_and_finished_in_one_worker(spark):
    """Two steps in a row would be two workers for each task, and the texts would travel twice."""
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"a {passage} b" if i % 2 else "other words") for i in range(1000)], "i long, text string")
    items = spark.createDataFrame([(1, passage), (2, "q " * 12)], "item_id long, text string")
    found = decontam.benchmark_hits(docs.coalesce(1), items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {(r["i"] % 2, r["n_hit"], tuple(r["items"])) for r in found.collect()} == {(0, 0, ()), (1, 20, ("1",))}
    more = decontam.benchmark_hits(docs.coalesce(1), items, block_bytes=300)
    passes = more._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert passes == len(list(decontam.blocks_of(decontam.item_windows(items), 300))) > 1
    assert sorted(more.collect(), key=lambda r: r["i"]) == sorted(found.collect(), key=lambda r: r["i"])
