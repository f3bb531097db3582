"""Operators over sequences of rows and words: conversation repair, repeated windows, phrases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtruth.llm import phrases, repair, windows
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TALK = "conv_id long, turn long, role string, text string"


# ---- repeated windows


def expected_kept(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    places = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - size + 1):
            places[tuple(w[i : i + size])].append((d, i))
    gone = [set() for _ in words]
    for held in places.values():
        if len(held) > 1:
            for d, i in held:
                gone[d].update(range(i, i + size))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g), g) for w, g in zip(words, gone)]


def check_windows(df, rows, size, **options):
    got = defaultdict(list)
    for r in windows.drop_repeated_words(df, window=size, **options).collect():
        flat = {x for s in r.spans for x in range(s.start, s.start + s.length)}
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
        got[r.doc_id].append((r.n_words, r.n_removed, r.text, tuple(sorted(flat))))
    want = defaultdict(list)
    for (doc, text, *_), (n, k, kept, gone) in zip(rows, expected_kept([r[1] for r in rows], size)):
        want[doc].append((n, k, kept, tuple(sorted(gone))))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


@pytest.mark.parametrize("size,shortest", [(35, 9), (35, 40), (7, 2), (1, 1), (12, 1)])
def test_repeated_windows(messy, messy_rows, monkeypatch, size, shortest):
    monkeypatch.setattr(windows, "PACK_BYTES", 3000)  # copies and passages stand in several packs
    monkeypatch.setattr(windows, "BUCKET_HASHES", 50)
    check_windows(messy, messy_rows, size, shortest=shortest)


def test_windows_inside_one_text(spark):
    part = prose(91, 40)
    rows = [(1, f"{part} x {part}"), (2, " ".join(["a"] * 36)), (3, " ".join(["b"] * 35)), (4, prose(92, 34)), (5, prose(92, 34)),
            (6, part.replace(" ", " \n\t ") + " y"), (7, part.upper())]
    check_windows(spark.createDataFrame(rows, "doc_id long, text string"), rows, 35)


def test_windows_of_long_texts(spark):
    body = prose(93, 300_000, 50_000)
    rows = [(1, body), (2, "start " + body[1_000_000:1_000_900]), (3, "z" * 3_000_000), (4, None)]
    check_windows(spark.createDataFrame(rows, "doc_id long, text string"), rows, 35)


def test_windows_nothing_clashing_and_strings(spark, nothing, clashing, messy_rows):
    assert windows.drop_repeated_words(nothing).collect() == []
    out = windows.drop_repeated_words(clashing)
    assert out.where("key <> 'mine key' OR a <> 'mine a'").count() == 0 and out.count() == len(messy_rows)
    upper = spark.createDataFrame([("x", "t " * 40, "other")], "Id string, text string, Text2 string")
    assert windows.drop_repeated_words(upper).first().n_removed == 40
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed, r.text, r.spans) for r in windows.drop_repeated_words(nulls).collect()] == [(0, 0, "", [])] * 2


def test_levels_double():
    assert windows.lengths(35, 9) == [9, 18, 35] and windows.lengths(8, 1) == [1, 2, 4, 8] and windows.lengths(5, 9) == [5]


def test_op12_query_on_a_folder(spark, messy, messy_rows, tmp_path):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in windows.op12_substring_dedup(spark, str(tmp_path)).collect())
    assert got == Counter((r[0], n, k, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, k, kept, _) in zip(
        messy_rows, expected_kept([r[1] for r in messy_rows], 35)))


# ---- phrases


def expected_phrases(rows, least, longest, share, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        scored = []
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, cut = min((1000 * a * total[lang] // (f[p[:j]] * f[p[j:]]), j) for j in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def wordy(seed, n):
    """Texts of few words, so that phrases come again, with separators, cases, controls and nulls."""
    r = random.Random(seed)
    vocabulary = ["New", "new", "york", "CITY", "é", "É", "a", "b", "c", "x\x01y", "of", "the", "[link]"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ; ", "\r\n", "\x0b"]
    out = [(lang, "".join(r.choice(vocabulary) + r.choice(gaps) for _ in range(r.randrange(40)))) for lang in ("en", "fr", None) for _ in range(n)]
    out += [("en", "new york city hall stands here")] * 9 + [("en", "the united states of america"), ("en", None), ("fr", ""), (None, "...")] * 6
    return out + [("de", " ".join(["ja"] * 30))]


@pytest.mark.parametrize("least,longest,share,top", [(6, 5, 100, 2000), (3, 3, 60, 7), (9, 2, 100, 40), (10**6, 5, 100, 5)])
def test_phrases(spark, monkeypatch, least, longest, share, top):
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 60)  # several tries
    rows = wordy(5, 25)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = phrases.mine_phrases(df, min_count=least, max_words=longest, share=share, top=top)
    assert sorted(map(tuple, got.collect())) == expected_phrases(rows, least, longest, share, top)


def test_phrases_with_shared_symbols(spark):
    """With 6 bits for 15 words of a language, frequent words share a symbol under most seeds; another one is looked for."""
    rows = [("en", t) for _, t in wordy(6, 10)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.mine_phrases(df, min_count=5, symbol_bits=9)
    assert sorted(map(tuple, got.collect())) == expected_phrases(rows, 5, 5, 100, 2000)


def test_phrases_exact_beyond_64_bits(spark):
    """1000 a n of a few billions of words passes 64 bits: the decimal form stays exact."""
    a, n, l, r = 123_456_789_012, 98_765_432_109_876, 123_456_789_013, 123_456_789_019
    row = spark.sql(f"SELECT (1000BD * cast({a}L AS decimal(19, 0)) * cast({n}L AS decimal(19, 0))) div (cast({l}L AS decimal(19, 0)) * cast({r}L AS decimal(19, 0)))").first()
    assert row[0] == 1000 * a * n // (l * r)


def test_phrases_nothing_and_clashing(spark, nothing, clashing):
    assert phrases.mine_phrases(nothing).collect() == []
    rows = [(r.lang, r.text) for r in clashing.select("lang", "text").collect()]
    got = phrases.mine_phrases(clashing, min_count=10)
    assert sorted(map(tuple, got.collect())) == expected_phrases(rows, 10, 5, 100, 2000)
    long = [("en", prose(70, 60_000, 30)), ("en", "q" * 2_000_000)]
    got = phrases.mine_phrases(spark.createDataFrame(long, "lang string, text string"), min_count=60, max_words=3)
    assert sorted(map(tuple, got.collect())) == expected_phrases(long, 60, 3, 100, 2000)


def test_double_array_counts():
    r = random.Random(3)
    symbols = np.array([r.randrange(2, 9) * (r.random() > 0.05) for _ in range(4000)], np.uint64)
    wanted = {tuple(symbols[i : i + k].tolist()) for i in range(0, 300, 3) for k in (2, 3, 5)}
    wanted = sorted(p for p in wanted if 0 not in p)
    tree = phrases.DoubleArray(np.array([x for p in wanted for x in p], np.uint64), np.array([len(p) for p in wanted]))
    counts, plain = tree.counts(symbols), symbols.tolist()
    assert len(set(tree.accept.tolist())) == len(wanted)
    for p, state in zip(wanted, tree.accept):
        assert counts[state] == sum(tuple(plain[i : i + len(p)]) == p for i in range(len(plain)))
    assert phrases.DoubleArray(symbols[:0], np.zeros(0, np.int64)).counts(symbols).sum() == 0


# ---- conversation repair


def expected_rows(rows):
    """(role, text, fault) of one conversation, in order."""
    out, seen = [], set()
    for turn, role, text in sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows),
                                   key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode())):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def expected_repair(rows):
    """Cheapest and least by carrying every way as a whole: cost, audit and repaired lines."""
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    who = {2: "user", 3: "assistant"}

    def add(ways):
        out = dict(ways)
        for _ in range(4):
            for s, (c, e, t) in list(out.items()):
                new = (c + 2, e + "I", (*t, (who[follow[s]], "")))
                out[follow[s]] = min(out.get(follow[s], new), new)
        return out

    ways = {0: (0, "", ())}
    for _, role, text, fault in rows:
        after = {}
        for s, (c, e, t) in add(ways).items():
            new = [(s, (c + 3, e + "D", t))]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(s)
                new += [] if to is None else [(to, (c + late, e + "K", (*t, (role, text))))]
                new.append((follow[s], (c + 2 + late, e + "R", (*t, (who[follow[s]], text)))))
            for to, way in new:
                after[to] = min(after.get(to, way), way)
        ways = after
    ended = add(ways)
    return min(ended[s] for s in (0, 3) if s in ended)


def every_repair(rows):
    """The same by trying all edits, with up to two insertions at each place."""
    best = None
    adds = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for between in itertools.product(adds, repeat=len(rows) + 1):
        for ops in itertools.product("KRSD", repeat=len(rows)):
            letters, edits, cost = "", "", 0
            for (turn, role, text, fault), op, more in zip(rows, ops, between):
                letters, edits, cost = letters + "".join(more), edits + "I" * len(more), cost + 2 * len(more)
                if op != "D" and fault in ("blank", "duplicate") or op == "K" and not role:
                    break
                cost += {"K": 0, "R": 2, "S": 2, "D": 3}[op] + (fault == "truncated" and op != "D")
                letters += {"K": role[:1], "R": "u", "S": "a", "D": ""}[op]
                edits += "R" if op == "S" else op
            else:
                letters, edits, cost = letters + "".join(between[-1]), edits + "I" * len(between[-1]), cost + 2 * len(between[-1])
                if re.fullmatch("(s?(ua)+)?", letters) and (best is None or (cost, edits) < best):
                    best = (cost, edits)
    return best


def talks(seed, sizes):
    r = random.Random(seed)
    texts = ["Well.", "Yes!", "no end", "", " \t", "Why? ", "same.", "a.b", None]
    return [(c, r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "sys", None, ""]),
             r.choice(texts)) for c, n in enumerate(sizes) for _ in range(n)]


def test_repair_by_trying_everything():
    for rows in (expected_rows(talks(s, [s % 4])) for s in range(60)):
        assert expected_repair(rows)[:2] == every_repair(rows)


def codes(rows):
    kind = {"s": 1, "u": 2, "a": 3}
    return bytes(kind.get(role[:1], 0) + (4 if f in ("blank", "duplicate") else 8 if f else 0) for _, role, _, f in rows)


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 3])  # with 3, nearly all strings collide
def test_blocks_of_a_conversation(monkeypatch, prime):
    monkeypatch.setattr(repair, "_PRIME", prime)
    repair.summary.cache_clear()
    for seed in range(25):
        rows = expected_rows(talks(seed, [seed * 3]))
        code = codes(rows)
        for size in (1, 4, 1000):
            parts = [code[i : i + size] for i in range(0, len(code), size)]
            ways, tail = repair.chosen([repair.summary(p) for p in parts])
            cost, edits, _ = expected_repair(rows)
            assert "".join(e for _, e in ways) + "I" * tail == edits
    repair.summary.cache_clear()


def test_longest_common_prefix():
    r = random.Random(1)
    edits, made = repair.Edits(), [(0, "")]
    for _ in range(600):
        node, text = r.choice(made)
        piece = "".join(r.choice("DI") for _ in range(r.randrange(1, 4)))
        made.append((edits.append(node, piece), text + piece))
    for x, s in r.sample(made, 120):
        assert edits.spelled(x) == s
        for y, t in r.sample(made, 60):
            assert edits.less(x, y) == (s < t) and edits.alike(x, y) == (s == t)


def check_repair(spark, rows, log):
    got = defaultdict(list)
    for r in sorted(log.collect(), key=lambda r: (r.place, r.step)):
        got[r.conv_id].append(r)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        want = expected_rows(own)
        _, edits, lines = expected_repair(want)
        assert "".join(r.edit for r in got[conv]) == edits
        assert tuple((r.role, r.text) for r in got[conv] if r.edit != "D") == lines
        assert [(r.turn, r.was, r.fault) for r in got[conv] if r.edit != "I"] == [(t, role, f) for t, role, _, f in want]
        assert all((r.turn, r.was, r.fault, r.text) == (None, None, None, "") for r in got[conv] if r.edit == "I")


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_repair_in_blocks(spark, bits):
    rows = talks(7, [0, 1, 2, 3, 5, 8, 40, 200]) + [(None, 0, "user", "Null."), (None, 1, "assistant", "Null."), (90, 0, "system", "Alone.")]
    rows += [(91, 0, "user", "Once.")] * 30 + [(92, k, "assistant" if k % 2 else "user", f"{k}.") for k in range(30)] + [(93, 0, "user", "z" * 1_000_000)]
    df = spark.createDataFrame(rows, TALK).repartition(7)
    check_repair(spark, rows, repair.repair_conversations(df, bits=bits))


def test_repair_nothing_and_clashing(spark):
    assert repair.repair_conversations(spark.createDataFrame([], TALK)).collect() == []
    rows = talks(8, [4, 6])
    df = spark.createDataFrame(rows, TALK).select("*", *[F.lit(f"mine {n}").alias(n) for n in ("codes", "tail", "KIND", "_0", "head", "tie", "edits")])
    log = repair.repair_conversations(df.withColumn("edit", F.lit("mine")))
    assert log.where("edit <> 'I' AND (codes <> 'mine codes' OR tie <> 'mine tie')").count() == 0 and log.where("edit = 'mine'").count() == 0
    check_repair(spark, rows, log)


def expected_digest(rows):
    import zlib

    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            own += [(c, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        want = expected_rows(own)
        cost, audit, lines = expected_repair(want)
        turns = {t for t, *_ in want if t is not None}
        faults = Counter(f for *_, f in want)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(want, want[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal,
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def test_op11_query_on_a_folder(spark, tmp_path):
    rows = talks(9, [3] * 60 + [25] * 4) + [(None, None, "user", "x.")] * 3 + [(500, 3, "assistant", "only é.")]
    rows += [(1000 + k, 0, "user", "gone?") for k in range(40)]  # some of them lose their only row
    spark.createDataFrame(rows, TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in repair.op11_structure_repair(spark, str(tmp_path)).collect()}
    assert got == expected_digest(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got.values()
