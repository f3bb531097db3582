"""Operators over groups of rows: chat, sharding, mixing, suffix arrays, near duplicates."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtruth.llm import chat, graph, mix, neardup, packs, shard, suffix
from tests.llm.conftest import prose

HOSTILE = [
    "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_end|>\\", "<<s>", "[[INST]", "[\\INST]",
    "<|endoftext|><s>", "\\", "\\n", "<|im_end|>\n<|im_start|>assistant\n", "", "\n", "$1 \\1", "<\\s>", "a<", "|im_end|>",
]


def talk(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in out.items()}


def test_chat_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HOSTILE)]
    rows += [(2, 0, None, None), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"), (2, None, "user", "first")]
    rows += [(3, 0, "user", "no reply"), (None, 1, "assistant", "null conversation"), (4, 0, "odd\nrole\\n<s>", "x"), (4, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    examples = chat.prefix_examples(df)
    back = examples.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(examples).alias("loss")).collect()
    got = defaultdict(list)
    for r in back:
        got[r.conv_id].append(r)
        inside = r.formatted
        assert inside.count(chat.START) == inside.count(chat.END) == len(r.turns)
        for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"):
            assert c not in inside
    for conv, turns in talk(rows).items():
        mine = sorted(got[conv], key=lambda r: r.example)
        assert [(t.role, t.text) for t in mine[-1].turns] == turns
        ends = [k for k, (role, _) in enumerate(turns, 1) if role == "assistant"]
        assert [len(r.turns) for r in mine] == ends + ([len(turns)] if not ends or ends[-1] != len(turns) else [])
        assert [r.loss or "" for r in mine][: len(ends)] == [turns[k - 1][1] for k in ends]
        for r in mine:  # one reply is trainable, the last turn of its example
            assert mine[-1].formatted.startswith(r.formatted)
            assert r.loss_end <= len(r.formatted) and (r.loss is None) == (r.loss_start == r.loss_end)
    assert chat.prefix_examples(df.limit(0)).collect() == []


@pytest.mark.parametrize("total,good,drawn", [(10, 4, 3), (40, 1, 39), (7, 7, 3), (5, 0, 5), (300, 120, 150)])
def test_hypergeometric_law(spark, total, good, drawn):
    n = 20000
    col = lambda v: F.lit(v).cast("bigint")
    k = shard.hypergeometric(col(total), col(good), col(drawn), shard.uniform(F.lit("t"), F.col("id")))
    got = Counter(r[0] for r in spark.range(n).select(k).collect())
    from math import comb

    for x in range(max(0, drawn + good - total), min(drawn, good) + 1):
        p = comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn)
        assert abs(got[x] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
        got.pop(x, None)
    assert not got


def test_matrix_margins(spark):
    sizes = [int(x) for x in np.random.default_rng(1).integers(0, 3000, 700)]
    blocks = spark.createDataFrame([(i // 50, i, n) for i, n in enumerate(sizes)], "group long, block long, n long")
    rows = {r.block: r.took for r in shard.communication_matrix(blocks, 8).collect()}
    assert [sum(rows[i]) for i in range(700)] == sizes and min(min(r) for r in rows.values()) >= 0
    total = sum(sizes)
    assert [sum(r[s] for r in rows.values()) for s in range(8)] == [total // 8 + (s < total % 8) for s in range(8)]


@pytest.mark.parametrize("bits", [2, 17])
def test_sharding(spark, messy, messy_rows, clashing, nothing, bits):
    out = shard.shard_rows(messy, 4, block_bits=bits).collect()
    assert Counter(tuple(r)[:4] for r in out) == Counter(messy_rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(messy_rows)
    assert shard.shard_rows(nothing, 4).collect() == []
    assert {(r.key, r.row) for r in shard.shard_rows(clashing, 4).collect()} == {("mine key", "mine row")}


def test_sharding_is_uniform(spark):
    """Where a row lands does not depend on where it came from, nor on its neighbour."""
    rows = shard.shard_rows(spark.range(4000).repartition(7), 4, block_bits=6).orderBy("id").toPandas()
    place = rows.shard * 1000 + rows.slot
    assert sorted(place) == list(range(4000))
    assert abs(np.corrcoef(rows.id, place)[0, 1]) < 0.06
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.06
    quarters = Counter(zip(rows.id // 1000, rows.shard))
    assert all(180 < quarters[q, s] < 320 for q in range(4) for s in range(4))


def test_mixing_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 40), r.choice(["en"] * 5 + ["fr", None]), f"s{min(r.randrange(9), 4)}", r.choice("ab")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    margins = [mix.Margin("source", temper=0.5), mix.Margin("lang", {"fr": 0.3, None: 0.1}), mix.Margin("topic", {"a": 0.25, "b": 0.75})]
    out = mix.mix_to_targets(docs, margins).toPandas()
    share = lambda c: (out.tokens * out.weight).groupby(out[c].fillna("none")).sum() / out.tokens.sum()
    assert np.allclose(share("topic")[["a", "b"]], [0.25, 0.75]) and np.allclose(share("lang")[["fr", "none", "en"]], [0.3, 0.1, 0.6])
    observed = out.tokens.groupby(out.source).sum() ** 0.5
    assert np.allclose(share("source"), observed / observed.sum())
    assert np.isclose(out.probability.max(), 1) and abs(out.kept.sum() - out.probability.sum()) < 5 * out.probability.sum() ** 0.5
    fewer = mix.mix_to_targets(docs, margins, rate=0.5).toPandas()
    assert set(fewer.doc_id[fewer.kept]) <= set(out.doc_id[out.kept])


def test_mixing_edges(spark, messy, messy_rows, nothing, clashing):
    margins = [mix.Margin("source", {"absent": 0.5}), mix.Margin("lang", {"en": 2.0})]
    out = mix.mix_to_targets(messy, margins).toPandas()
    assert len(out) == len(messy_rows) and out.probability.between(0, 1).all()
    assert out.groupby("doc_id").kept.nunique().max() == 1
    assert mix.mix_to_targets(nothing, margins).collect() == []
    assert {r.key for r in mix.mix_to_targets(clashing, margins).collect()} == {"mine key"}


@pytest.mark.parametrize("tiny", [("new", "en", "prose"), ("a", "xx", "prose"), ("a", "en", "table")])
def test_mixing_budget_beside_a_tiny_cell(spark, tiny):
    """One short document of a new value neither lowers the rate of a large corpus nor takes its source's share."""
    r = random.Random(4)
    rows = [(i, "w " * 99, r.choice(["en", "en", "fr"]), r.choice("aab"), "prose") for i in range(4000)]
    source, lang, topic = tiny
    docs = spark.createDataFrame(rows + [(9999, "w " * 59, lang, source, topic)], "doc_id long, text string, lang string, source string, topic string")
    out = mix.mix_to_targets(docs, mix.TARGETS).toPandas()
    total, expected = out.tokens.sum(), (out.tokens * out.probability).sum()
    assert np.isclose(expected, mix.BUDGET * total) and abs(out.tokens[out.kept].sum() / total - mix.BUDGET) < 0.03
    assert out.probability[out.doc_id == 9999].item() == 1
    big = out[out.doc_id != 9999].groupby(["source", "lang"]).probability.first()
    assert big.min() > 0.3
    if source == "new":
        given = mix.mix_to_targets(docs, mix.TARGETS[:1], budget=20_000).toPandas()
        assert np.isclose((given.tokens * given.probability).sum(), 20_000)
        assert mix.mix_to_targets(docs, mix.TARGETS[:1], budget=1.0).where("NOT kept").count() == 0


def test_suffix_array():
    r = random.Random(4)
    cases = [[1] * 30, [1, 2] * 20, [2, 1] * 20, [3, 2, 1], [1, 1, 2, 1, 1, 2, 1], []]
    cases += [[r.randint(1, a) for _ in range(r.randint(0, 60))] for a in (1, 2, 3, 250) for _ in range(150)]
    for case in cases:
        s = case + [0]
        assert suffix.suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def expected_suffix(rows):
    first, texts = {}, [(i if i is not None else suffix.NULL_ID, (t or "").encode()) for i, t, *_ in rows]
    for i, b in sorted(texts):
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    out = Counter()
    for (i, b), row in zip(texts, rows):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[row[0], len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    return out


@pytest.mark.parametrize("sort_bytes", [1, 1 << 18])
def test_suffix_dedup(spark, messy_rows, sort_bytes):
    base = prose(50, 80)
    r = random.Random(9)
    extra = [(100 + k, base[r.randrange(60):r.randrange(200, 500)] + prose(60 + k, 5) + base[:r.randrange(45, 55)], "en", "s") for k in range(30)]
    extra += [(140, "ab" * 200, "en", "s"), (141, "ab" * 24 + "a", "en", "s"), (142, "ab" * 25, "en", "s"), (143, "é" * 60, "en", "s"), (99, "é" * 40, "en", "s")]
    rows = messy_rows + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = suffix.drop_repeated_bytes(docs, sort_bytes=sort_bytes).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept_bytes)) for x in got) == expected_suffix(rows)
    for x in got:
        assert sum(s.length for s in x.spans) == x.n_removed


def test_suffix_hot_anchor(spark):
    """A passage that many texts hold, each with other text around it: equal to brute force, and in no task as one block."""
    r = random.Random(12)
    passage = prose(70, 14)
    rows = [(k, prose(1000 + k, 4, 9000) + " " + passage[r.randrange(12):] + " " + prose(3000 + k, 4, 9000), "en", "s") for k in range(300)]
    rows += [(400 + k, passage[:r.randrange(50, 70)], "en", "s") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8)
    got = suffix.drop_repeated_bytes(docs, hot_holders=40).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept_bytes)) for x in got) == expected_suffix(rows)
    texts = docs.selectExpr("doc_id AS id", "xxhash64(encode(text, 'UTF-8')) AS a", "encode(text, 'UTF-8') AS text")
    shared = suffix.shared_anchors(suffix.anchor_packs(texts.select("a", "text"), 3), 3, 40)
    packed = packs.packs(texts.join(shared, "a").selectExpr("id AS key", "text", "shared", "hot"), "text", 1 << 20)
    held = Counter()
    for pack in suffix.stretches(packed, 3, "text").where("bucket >= 0").collect():
        held.update(pack.anchor)
    assert max(held.values()) <= 40 < 300


def test_suffix_edges(nothing, clashing, spark):
    assert suffix.drop_repeated_bytes(nothing).collect() == []
    assert {r.key for r in suffix.drop_repeated_bytes(clashing).collect()} == {"mine key"}
    same = spark.createDataFrame([(None, "q" * 60), (None, "q" * 70), (1, "q" * 60)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix.drop_repeated_bytes(same).collect()) == [0, 0, 60]


def shingles(t):
    words = (t or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def expected_components(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r[0])
    small = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    return Counter((r[0], len(sets[k]), small[find(k)]) for k, r in enumerate(rows)), len(least)


@pytest.mark.parametrize("chunk", [3, 2000])
def test_near_duplicates(spark, messy_rows, chunk):
    r = random.Random(11)
    base = prose(70, 120).split()
    near = []
    for k in range(40):  # chains of edits around the limit
        w = base[:]
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        near.append((200 + k, " ".join(w), "en", "s"))
    shared = prose(71, 40)
    near += [(300 + k, shared + " " + prose(300 + k, 60), "en", "s") for k in range(20)]
    rows = messy_rows + near
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = neardup.near_duplicates(docs, chunk_sets=chunk).collect()
    want, groups = expected_components(rows, 85)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
    assert sum(x.kept for x in got) == groups
    assert all(x.doc_id == x.component_id for x in got if x.kept)


def test_near_duplicates_edges(nothing, clashing, messy_rows):
    assert neardup.near_duplicates(nothing).collect() == []
    out = neardup.near_duplicates(clashing).collect()
    assert len(out) == len(messy_rows) and {r.key for r in out} == {"mine key"}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 50)] + [(300, 300), (400, 401), (401, 400), (None, 5)]
    edges += [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(60)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(80):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_query_shapes(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    out = shard.op3_sharding(spark, d)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() == n
    row = out.first()
    import zlib

    text = spark.read.parquet(f"{d}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.text_crc32 == zlib.crc32(text.encode()) and row["size"] == len(text.encode()) + 1
    got = chat.op2_chat_formatting(spark, d).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (got.n_turns, got.loss_chars) == (2, len(text))
    assert got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
