"""Quality rules: compression bands over whole documents and fixed chunks.

A text that repeats itself compresses too well, noise compresses too badly. The zstandard ratio (raw
bytes over compressed bytes) of the whole text and of each fixed chunk must lie inside a band that
depends on the length, since short texts never compress well. Word and line counts, which are cheap
and easy to explain, are reported beside the ratios and can fail a text on their own.

One narrow pass: no shuffle, a document at a time, memory bounded by an Arrow batch.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtruth.llm.common import map_batches, numbered, position, restored


class Band(NamedTuple):
    """Limits for texts of at least ``from_bytes`` bytes: raw over compressed size."""

    from_bytes: int
    low: float
    high: float


#: Whole texts. Below the first band, a text is too short for its ratio to say anything. The limits follow the smallest
#: and largest ratios of texts that the base rules accept in sf0.1 and check_s (some mix languages), with a margin.
DOCUMENT_BANDS = (
    Band(256, 1.25, 2.05), Band(512, 1.38, 2.35), Band(1024, 1.58, 2.6), Band(2048, 1.75, 2.75), Band(4096, 1.93, 2.9),
    Band(8192, 2.03, 3.05), Band(16384, 2.15, 3.2), Band(65536, 2.15, 3.5),
)
#: Chunks of ``CHUNK_BYTES``; the rest of a text counts as a chunk of its own length.
CHUNK_BANDS = (Band(1024, 1.58, 2.6), Band(2048, 1.75, 2.75), Band(4096, 1.93, 2.9), Band(8192, 2.0, 3.05))
CHUNK_BYTES = 8192
#: A text fails if more than this share of its chunks (by bytes) lies outside.
BAD_CHUNK_SHARE = 0.2
LEVEL = 3

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("base_failed", "boolean"), ("ratio", "double"), ("bad_chunk_share", "double"),
    ("band_verdict", "string"), ("kept", "boolean"),
]


def repeated_words(words: Sequence[bytes]) -> int:
    """Words covered by a three-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) >= 2_000_000:  # a product of three would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = twice[:n].copy()
    hit[1:] |= twice[: n - 1]
    hit[2:] |= twice[: n - 2]
    return int(hit.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = raw.split(b"\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if x and not x.isspace()]
    return len(worded) - len(set(worded))


def outside(ratio: float, size: int, bands: Sequence[Band]) -> int:
    """-1: does not compress, 1: compresses too well, 0: inside, or too short to tell."""
    k = bisect_right([b.from_bytes for b in bands], size) - 1
    if k < 0:
        return 0
    return -1 if ratio < bands[k].low else 1 if ratio > bands[k].high else 0


def compression_bands(docs: DataFrame, text: str = "text", document_bands: Sequence[Band] = DOCUMENT_BANDS,
                      chunk_bands: Sequence[Band] = CHUNK_BANDS, chunk_bytes: int = CHUNK_BYTES,
                      bad_chunk_share: float = BAD_CHUNK_SHARE, level: int = LEVEL,
                      min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """All rows of ``docs`` with the counts, ratios and verdict of each text.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in
    repeated three-word windows. ``band_verdict``: ``repetitive`` or ``incompressible`` where the whole text,
    or more than ``bad_chunk_share`` of its chunks by bytes, leaves its band, else ``inside``.
    ``kept``: neither.

    A null text counts as one without words: ratio 0, base failed. An empty text likewise. Rows are judged one
    by one, so repeated rows get equal verdicts; an empty table gives an empty table.
    """
    document_bands, chunk_bands = tuple(map(tuple, document_bands)), tuple(map(tuple, chunk_bands))
    document_bands = tuple(Band(*b) for b in document_bands)
    chunk_bands = tuple(Band(*b) for b in chunk_bands)

    def judge(texts: list) -> list[list]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        rows = []
        for s in texts:
            s = s or ""
            raw = s.encode("utf-8", "replace")
            words = raw.split()
            n = len(words)
            repeat = repeated_words(words)
            failed = n < min_words or 100 * repeat > max_repeat_percent * n
            ratio = len(raw) / len(press.compress(raw)) if raw else 0.0
            side = outside(ratio, len(raw), document_bands)
            bad = {-1: 0, 0: 0, 1: 0}
            if len(raw) > chunk_bytes:
                for at in range(0, len(raw), chunk_bytes):
                    piece = raw[at:at + chunk_bytes]
                    bad[outside(len(piece) / len(press.compress(piece)), len(piece), chunk_bands)] += len(piece)
            share = (bad[-1] + bad[1]) / len(raw) if raw else 0.0
            if not side and share > bad_chunk_share:
                side = 1 if bad[1] >= bad[-1] else -1
            white = sum(raw.count(bytes([c])) for c in WHITE)
            rows.append((
                n, len(s) - white, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeat, failed,
                ratio, share, ("incompressible", "inside", "repetitive")[side + 1], not failed and not side,
            ))
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in FIELDS]

    at = position(docs, text)
    judged = map_batches(numbered(docs), [f"_{at}"], judge, FIELDS)
    return restored(judged, docs.columns, [n for n, _ in FIELDS])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = compression_bands(docs)
    return out.select("doc_id", *[n for n, _ in FIELDS if n not in ("ratio", "bad_chunk_share")],
                      F.round("ratio", 6).alias("ratio"), F.round("bad_chunk_share", 6).alias("bad_chunk_share"))
