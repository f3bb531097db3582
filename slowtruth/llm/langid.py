"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: after a context of up to three bytes, which byte came how often in
the language's texts. A byte that a context has not seen is coded by an escape and the next shorter context,
without the bytes already ruled out (escape method C with exclusion); after the empty context all bytes left are
alike. Statistics are frozen after fitting, so the code length of a byte depends on the three bytes before it alone.
All code lengths are therefore worked out once, as one table of (context state, byte), and a text's exact code length
in every language is a sum of table rows. The shortest code names the language.

Fitting reads at most ``FIT_TEXTS`` texts of a language; scoring is one narrow pass over all bytes of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slowtruth.llm.common import map_batches, numbered, position, restored, take

ORDER = 3
#: Whole texts of each language that the statistics are taken from: those with the smallest hashes.
FIT_TEXTS = 1000
#: Positions scored at once.
WINDOW = 1 << 20
UNKNOWN = "und"


class Model(NamedTuple):
    """Frozen statistics: byte -> symbol, three symbols -> state, (state, symbol) -> bits in each language."""

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of a byte after its context, as a number of four bytes; zero bytes stand before a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = b"\0" * ORDER
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text.encode("utf-8", "replace"))
            for lang, texts in by.items():
                for at in range(0, len(texts), 200):
                    part = texts[at:at + 200]
                    b = np.frombuffer(pad + pad.join(part), np.uint8).astype(np.uint32)
                    grams = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
                    lengths = np.array([len(t) for t in part])
                    ends = np.cumsum(lengths + ORDER)
                    real = np.ones(len(grams), bool)
                    for k in range(ORDER):  # the padding itself is not coded
                        real[ends[:-1] - ORDER + k] = False
                    values, n = np.unique(grams[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n)],
                        names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_sample(docs: DataFrame, lang: str, text: str, fit_texts: int) -> DataFrame:
    """(lang, text): of each language the ``fit_texts`` different texts with the smallest hashes."""
    rows = take(docs, lang=lang, text=text).where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    cut = rows.select("lang", "h").distinct().withColumn("k", first).where(F.col("k") <= fit_texts).groupBy("lang").agg(
        F.max("h").alias("cut"))
    # a row for each language, of which the model holds a whole table: small beside it, and no text is shuffled for it
    return rows.join(F.broadcast(cut), "lang").where("h <= cut").groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def code_lengths(counts: list[np.ndarray], left: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each symbol after each of S contexts, and of a symbol outside the alphabet.

    ``counts``: for contexts from the longest to the empty one, an array (S, symbols). ``left``: bytes outside the alphabet.
    """
    shape = counts[0].shape
    bits, escape = np.zeros(shape), np.ones(shape[0])
    ruled_out = np.zeros(shape, bool)
    probability = np.zeros(shape)
    for n in counts:
        n = np.where(ruled_out, 0, n)
        total, kinds = n.sum(1), (n > 0).sum(1)
        seen = n > 0
        scale = np.divide(escape, total + kinds, out=np.zeros_like(escape), where=total > 0)
        probability = np.where(seen, n * scale[:, None], probability)
        escape = np.where(total > 0, kinds * scale, escape)
        ruled_out |= seen
    alike = escape / np.maximum((~ruled_out).sum(1) + left, 1)
    probability = np.where(ruled_out, probability, alike[:, None])
    # a context that has seen all 256 bytes leaves nothing to an escape; the floor only keeps the logarithm finite
    bits = -np.log2(np.maximum(probability, 1e-30))
    return bits.astype(np.float32), -np.log2(np.maximum(alike, 1e-30)).astype(np.float32)


def build(langs: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Model:
    """The table of code lengths from the counts of all languages."""
    languages = sorted(set(langs.tolist()))
    byte = np.stack([grams >> 24 & 255, grams >> 16 & 255, grams >> 8 & 255, grams & 255])
    used = np.unique(np.concatenate([byte.ravel(), [0]]))
    symbol = np.full(256, len(used), np.int32)  # bytes never seen share one symbol
    symbol[used] = np.arange(len(used))
    a = len(used) + 1
    s = symbol[byte].astype(np.int64)
    contexts = [(s[0] * a + s[1]) * a + s[2], s[1] * a + s[2], s[2], np.zeros(len(grams), np.int64)]
    # a state for each context of each length; longer ones first
    kinds = [np.unique(c) for c in contexts]
    offsets = np.cumsum([0, *[len(k) for k in kinds]])
    total = int(offsets[-1])
    # for each state, its own shorter contexts: the last symbols of its name
    chains = np.full((ORDER + 1, total), -1, np.int64)
    for depth, names in enumerate(kinds):
        rows = slice(offsets[depth], offsets[depth + 1])
        for k in range(depth, ORDER + 1):
            short = names % a ** (ORDER - k) if k < ORDER else np.zeros(len(names), np.int64)
            at = np.searchsorted(kinds[k], short)
            chains[k, rows] = np.where((at < len(kinds[k])) & (kinds[k][np.minimum(at, len(kinds[k]) - 1)] == short), at, -1)
    bits = np.zeros((total, a, len(languages)), np.float32)
    for j, name in enumerate(languages):
        own = langs == name
        tables = []
        for k in range(ORDER + 1):
            table = np.zeros((len(kinds[k]) + 1, len(used)), np.float64)  # the last row: a context of no length here
            np.add.at(table, (np.searchsorted(kinds[k], contexts[k][own]), s[3][own]), n[own])
            tables.append(table)
        for at in range(0, total, 4096):
            part = slice(at, min(at + 4096, total))
            known, other = code_lengths([tables[k][chains[k, part]] for k in range(ORDER + 1)], 256 - len(used))
            bits[part, : len(used), j], bits[part, len(used), j] = known, other
    # three symbols before -> the longest context that any language has seen
    state = np.full(a**3, offsets[3], np.int32)
    for k in (2, 1, 0):
        span = a ** (ORDER - k)
        view = state.reshape(-1, span)
        view[:, kinds[k]] = (np.arange(len(kinds[k])) + offsets[k]).astype(np.int32)[None, :]
    return Model(languages, symbol, state, bits.reshape(total * a, len(languages)))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", fit_texts: int = FIT_TEXTS) -> Model | None:
    """Statistics of all labels in ``docs``; None without labelled texts. What reaches the driver is bounded by the sample."""
    got = gram_counts(fit_sample(docs, lang, text, fit_texts)).toArrow()
    if not got.num_rows:
        return None
    return build(np.array(got["lang"].to_pylist()), got["gram"].to_numpy(), got["n"].to_numpy())


def text_bits(model: Model, texts: list[bytes]) -> np.ndarray:
    """Exact code length of each text in each language: (texts, languages)."""
    pad = b"\0" * ORDER
    b = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    a = len(model.bits) // (int(model.state.max()) + 1)
    lengths = np.array([len(t) for t in texts], np.int64)
    # borders of texts and of the padding after each, by turns, counted from the first coded position
    borders = np.empty(2 * len(texts), np.int64)
    borders[0::2] = np.concatenate(([0], np.cumsum(lengths + ORDER)[:-1]))
    borders[1::2] = borders[0::2] + lengths
    out = np.zeros((2 * len(texts), len(model.languages)))
    coded = len(b) - ORDER
    for lo in range(0, coded, WINDOW):
        hi = min(lo + WINDOW, coded)
        s = model.symbol[b[lo : hi + ORDER]]
        state = model.state[(s[:-3] * a + s[1:-2]) * a + s[2:-1]]
        cost = model.bits[state.astype(np.int64) * a + s[3:]]
        first, last = np.searchsorted(borders, lo, "right") - 1, np.searchsorted(borders, hi, "left")
        cuts = np.maximum(borders[first:last], lo) - lo
        keep = np.diff(np.concatenate((cuts, [hi - lo]))) > 0  # reduceat takes an empty run for one element
        sums = np.add.reduceat(cost, cuts[keep], axis=0, dtype=np.float64)
        out[np.arange(first, last)[keep]] += sums
    return out[0::2]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows of ``docs`` with the language of the shortest code and its share of the likelihood of all languages.

    Null texts and those without a letter are ``und`` with score 0; so are all without a model. Of equal code lengths
    the first language by name wins. A text is coded from its first to its last byte, however long.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: list) -> list[list]:
        model = shared.value
        names = [UNKNOWN] * len(texts)
        scores = [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
        for at in range(0, len(known), 256):
            part = known[at:at + 256]
            bits = text_bits(model, [texts[i].encode("utf-8", "replace") for i in part])
            share = np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
            for i, k, p in zip(part, bits.argmin(1), 1 / share):
                names[i], scores[i] = model.languages[k], float(p)
        return [names, scores]

    out = map_batches(numbered(docs), [f"_{position(docs, text)}"], label, [(into[0], "string"), (into[1], "double")])
    return restored(out, names, into)


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
