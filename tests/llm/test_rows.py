"""Operators that judge or change one document at a time, or count over all: lines, tokens, quality, decontamination, language."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtruth.llm import decontam, langid, lines, quality, tokens
from tests.llm.conftest import LINE, prose

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_lines(rows):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(FOLD)
            if len(key) >= 20:
                holders[key].add(i)
    out = Counter()
    for i, t, *_ in rows:
        kept = [x for x in (t or "").split("\n") if len(holders[k := x.strip(SPACE).translate(FOLD)]) < 3
                or i == max(j for j in holders[k] if j is not None)]
        n = (t or "").count("\n") + 1
        out[i, n, n - len(kept), "\n".join(kept)] += 1
    return out


def test_lines(messy, messy_rows):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.drop_shared_lines(messy).collect())
    assert got == expected_lines(messy_rows)
    assert sum(n for _, _, n, _ in got) == 8 and (24, 5, 0) in {k[:3] for k in got}


def test_lines_edges(nothing, clashing, messy_rows, spark):
    assert lines.drop_shared_lines(nothing).collect() == []
    out = lines.drop_shared_lines(clashing)
    assert out.count() == len(messy_rows) and "n_lines" in out.columns and "N_LINES" not in out.columns
    assert {r.key for r in out.collect()} == {"mine key"}
    # a null id is one document below all others
    rows = [(None, LINE), (None, LINE), (1, LINE), (2, LINE)]
    got = {(r.doc_id, r.n_dropped) for r in lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 1), (1, 1), (2, 0)}


def expected_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    repeat = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n)


def test_quality_counts(messy, messy_rows):
    got = Counter(tuple(r) for r in quality.compression_bands(messy).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((r[0], *expected_quality(r[1])) for r in messy_rows)


def test_quality_bands(spark, nothing, clashing):
    import base64
    import random

    noise = base64.b85encode(random.Random(1).randbytes(9000)).decode()
    noise = " ".join(noise[i:i + 9] for i in range(0, len(noise), 9))
    half = prose(8, 2000) + " " + " ".join(f"{i % 7}" for i in range(1)) + " " + ("the same old song " * 3000)
    rows = [(1, prose(7, 400)), (2, noise), (3, "over and over again " * 400), (4, half), (5, None), (6, "")]
    got = {r.doc_id: r for r in quality.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].band_verdict == "inside"
    assert got[2].band_verdict == "incompressible" and not got[2].kept
    assert got[3].band_verdict == got[4].band_verdict == "repetitive"
    assert not got[5].kept and got[5].ratio == 0 and not got[6].kept
    assert quality.compression_bands(nothing).collect() == []
    assert {r.key for r in quality.compression_bands(clashing).collect()} == {"mine key"}


def test_quality_bands_by_length(spark):
    """Texts that pass the base rules: noise and half-pasted texts fall out at the lengths named, clean ones stay."""
    import base64
    import random

    import pyarrow.parquet as pq

    r = random.Random(3)
    cut = lambda s, n: " ".join(s[i:i + 6] for i in range(0, n, 6))
    noise = {
        "hex": (4096, lambda n: r.randbytes(n).hex()), "base64": (350, lambda n: base64.b64encode(r.randbytes(n)).decode()),
        "letters": (2048, lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))),
    }
    bad = [(f"{name} {n}", cut(make(n), n)) for name, (least, make) in noise.items() for n in (350, 700, 2048, 4096, 9000, 30000, 90000) if n >= least]
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    clean = sorted({t for t in texts if t and not expected_quality(t)[-1]})
    words = " ".join(clean).split()
    phrase = " ".join(words[:12])
    for n in (300, 1000, 4000, 12000):  # 44 % of the words are one pasted sentence
        whole = [words[100 + i:100 + i + 15] for i in range(0, n * 56 // 100, 15)]
        bad.append((f"pasted {n}", " ".join(" ".join([*w, phrase]) for w in whole)))
    rows = bad + [(f"clean {k}", t) for k, t in enumerate(clean)]
    got = {x.name: x for x in quality.compression_bands(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert not any(x.base_failed for x in got.values())
    assert [name for name, _ in bad if got[name].kept] == []
    assert all(got[name].band_verdict == ("repetitive" if "pasted" in name else "incompressible") for name, _ in bad)
    assert sum(not got[f"clean {k}"].kept for k in range(len(clean))) == 0 and len(clean) > 700


def test_quality_long_product():
    """More different words than a product of three numbers can hold."""
    words = [b"%d" % i for i in range(2_000_001)] + [b"0", b"1", b"2"]
    assert quality.repeated_words(words) == 6


def expected_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    words, hit, ids = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        size = min(10, len(w))
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, messy_rows, block_bytes):
    passage = prose(2, 30)
    items = [(1, passage), (2, "ONE"), (3, None), (4, "...!"), (5, passage.upper()), (10, "a-b  C"), (None, "b c d"), (7, prose(99, 12))]
    rows = messy_rows + [(90, f"Début: {passage.upper().replace(' ', ' -- ')}; fin", "fr", "s"), (91, "a b c d a b c " * 3, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = decontam.benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    named = [("null" if i is None else i, t) for i, t in items]
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == Counter(
        (i, n, h, tuple(ids)) for i, t, *_ in rows for n, h, ids in [expected_hits(t, named)])
    for r in found:
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"])
        for s in r.spans:
            inside = decontam.WORD.findall(r.text[s.start:s.end])
            assert len(inside) == s.last_word - s.first_word + 1
            assert r.text[s.start:s.end].startswith(inside[0]) and r.text[s.start:s.end].endswith(inside[-1])
    assert [len(r.spans) for r in found if r.doc_id == 90] == [1]


def test_decontamination_edges(spark, nothing, clashing, messy):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontam.benchmark_hits(nothing, items).collect() == []
    assert not any(r.contaminated for r in decontam.benchmark_hits(messy, items.limit(0)).collect())
    assert {r.key for r in decontam.benchmark_hits(clashing, items).collect()} == {"mine key"}


def test_token_counts(messy, messy_rows, nothing):
    for block in (7, 1 << 13):
        stream = tokens.write_token_stream(messy, block_tokens=block)
        got = tokens.documents_in(stream, group_blocks=3)
        written = stream.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).selectExpr("file", "first + k AS ordinal", "doc_id")
        out = written.join(got, ["file", "ordinal"], "full").collect()
        assert Counter((r.doc_id, r.n_tokens, r.closed) for r in out) == Counter(
            (r[0], len((r[1] or "").encode()), True) for r in messy_rows)
    assert tokens.documents_in(tokens.write_token_stream(nothing)).collect() == []


def test_flat_files(spark, tmp_path):
    """Files of any other writer: open ends, separators in a row, empty files, several blocks."""
    rng = np.random.default_rng(5)
    want = {}
    for k, ids in enumerate([rng.integers(1, 6, 5000), np.array([1, 1, 1]), np.array([7, 8]), np.array([], int), np.full(1000, 9)]):
        ids.astype("<u4").tofile(tmp_path / f"f{k}.bin")
        parts = "".join("|" if i == 1 else "x" for i in ids).split("|")
        sizes = [(len(p), True) for p in parts[:-1]] + ([(len(parts[-1]), False)] if parts[-1] else [])
        want |= {(f"f{k}.bin", n): s for n, s in enumerate(sizes)}
    blocks = tokens.read_flat_files(spark, f"{tmp_path}/*.bin", width=4, block_tokens=64)
    got = tokens.documents_in(blocks, width=4, group_blocks=4).collect()
    assert {(r.file.rsplit("/")[-1], r.ordinal): (r.n_tokens, r.closed) for r in got} == want
    odd = blocks.select("file", "block", F.lit(b"abc").alias("tokens"))
    with pytest.raises(Exception, match="inside a token"):
        tokens.documents_in(odd, width=4).collect()


def test_tokenizer_ids(messy, messy_rows):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    from tokenizers import Tokenizer

    end = Tokenizer.from_file(path).get_vocab_size()
    stream = tokens.write_token_stream(messy.where("doc_id BETWEEN 4 AND 10"), encode=tokens.tokenizer_ids(path, end), end_id=end, width=4)
    got = tokens.documents_in(stream, end_id=end, width=4).collect()
    tok = Tokenizer.from_file(path)
    want = [len(tok.encode(t, add_special_tokens=False).ids) for i, t, *_ in messy_rows if i and 4 <= i <= 10]
    assert sorted(r.n_tokens for r in got) == sorted(want)


def slow_bits(texts, text):
    """Code length of one text under one language: dictionaries, one byte at a time."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        b = b"\0\0\0" + t
        for i in range(3, len(b)):
            for k in range(4):
                counts[k][b[i - k:i]][b[i]] += 1
    bits, b = 0.0, b"\0\0\0" + text
    for i in range(3, len(b)):
        p, out = 1.0, set()
        for k in (3, 2, 1, 0):
            seen = {s: n for s, n in counts[k][b[i - k:i]].items() if s not in out}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if b[i] in seen:
                p *= seen[b[i]] / total
                break
            p *= len(seen) / total
            out |= set(seen)
        else:
            p /= 256 - len(out)
        bits -= np.log2(p)
    return bits


def test_code_lengths(spark, monkeypatch):
    train = {"en": ["the cat sat on the mat", "a dog and the cat", "the the"], "fr": ["le chat est là", "été à la plage"], "xx": ["zz"]}
    rows = [(lang, t) for lang, ts in train.items() for t in ts]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["en", "fr", "xx"]
    texts = ["the chat", "là-bas", "q", "zzz the", "\x00", "漢字", "the cat " * 40]
    monkeypatch.setattr(langid, "WINDOW", 5)  # texts cross the windows of the scan
    got = langid.text_bits(model, [t.encode() for t in texts])
    want = [[slow_bits([x.encode() for x in train[k]], t.encode()) for k in model.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-4)


def test_language_edges(spark, messy, nothing, clashing):
    docs = spark.createDataFrame([("en", prose(1, 50)), ("en", None), (None, "no label"), ("fr", "été à la plage " * 5)], "lang string, text string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(messy, model).where("doc_id IS NOT NULL").collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3, 18))
    assert got[10].lang_pred == "en" and 0.5 < got[10].score <= 1
    assert langid.identify(nothing, model).collect() == [] and langid.fit(nothing) is None
    assert {r.lang_pred for r in langid.identify(messy, None).collect()} == {"und"}
    assert {r.key for r in langid.identify(clashing, model).collect()} == {"mine key"}


def test_language_held_out(spark):
    out = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 150 and (out.lang == out.lang_pred).mean() > 0.99


def test_digests(spark):
    """The registered query is the operator's output, no more."""
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in lines.drop_shared_lines(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    for r in lines.op1_line_dedup(spark, d).collect():
        assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
