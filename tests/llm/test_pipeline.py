"""The pipeline on a small folder of tables: each stage against brute force on what its predecessor kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from slowtruth.llm import mix
from tests.llm.conftest import prose
from tests.llm.test_groups import shingles
from tests.llm.test_rows import expected_hits, expected_quality


@pytest.fixture(scope="module")
def folder(spark, messy_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = messy_rows + [(400 + k, prose(400 + k, 70), "de" if k % 3 else "en", f"s{k % 4}") for k in range(60)]
    rows += [(500 + k, prose(400 + k, 70) + " end", "en", "s") for k in range(10)] + [(600, "noise " * 900, "en", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(2, 30)), (2, prose(405, 70)[:200])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, monkeypatch):
    # one margin is met in a single round; the production targets are checked by the query's SQL
    monkeypatch.setattr(mix, "TARGETS", [mix.Margin("source", temper=0.7)])
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near dedup", "benchmark decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [[tuple(r) for r in docs.collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        kept.append([tuple(r) for r in out.collect()])
        docs = spark.createDataFrame(kept[-1], out.schema)
        assert set(r[:5] for r in kept[-1]) <= set(r[:5] for r in kept[-2])
    start, good, single, clean, mixed, sharded = kept
    assert len(good) < len(start) and not any(expected_quality(r[1])[-1] for r in good)
    assert {r[0] for r in start if r[0] and 400 <= r[0] < 500} <= {r[0] for r in good} and 600 not in {r[0] for r in good}
    sets = [shingles(r[1]) for r in good]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    parent = list(range(len(good)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if near(sets[a], sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(good):
        groups[find(k)].append(r[0])
    ranked = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    assert Counter(r[0] for r in single) == Counter(ranked(ids) for ids in groups.values())
    assert Counter(clean) == Counter(r for r in single if not expected_hits(r[1], items)[1])
    assert len(clean) < len(single)
    rows = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")
    again = mix.mix_to_targets(rows.withColumn("topic", mix.form(rows.text)), mix.TARGETS).where("kept")
    assert Counter(r[0] for r in mixed) == Counter(r.doc_id for r in again.collect()) and mixed
    assert Counter(r[:5] for r in sharded) == Counter(mixed)
    slots = defaultdict(list)
    for r in sharded:
        slots[r[5]].append(r[6])
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())

