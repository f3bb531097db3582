"""Suffix-array dedup: bytes covered by strings that an earlier document holds.

Two strings of 50 bytes are equal only if they meet in one suffix array, so the work is to bring equal strings
together without moving or sorting what is unique:

1. Every 50-byte window has an anchor, the position in it whose 24 bytes hash lowest. Equal windows have equal
   anchors. Anchors that only one text holds drop out; texts of several rows are one text.
2. Of an anchor that is left, the stretch of windows it stands for is cut out. Equal stretches are one, held by the
   smallest id; later holders lose the stretch, the first one goes on.
3. Stretches of one anchor meet in one task. Their suffix array is built by linear grouping, and runs of suffixes
   equal over 50 bytes give each window's smallest id. The stretches of an anchor that very many texts hold are cut
   into their windows (at most 27), and only equal windows meet, so that these texts spread over all tasks.
4. Lost windows return to their documents and are merged into runs.

The suffix array is that of U. Baier, "Linear-time Suffix Sorting" (CPM 2016). Suffixes start in groups by their
first character. Groups are processed in descending order: each suffix of a group finds its previous smaller suffix,
whose group is extended by the strings found, so that in the end a group holds the suffixes of one Lyndon prefix. The
second phase walks the result in ascending order and places each suffix before its previous smaller ones. No
recursion, no new names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtruth.llm.common import map_batches, numbered, position, restored, to_arrow_schema
from slowtruth.llm.packs import opened, packs, texts_of
from slowtruth.llm.rolling import Ranges, combined, sliding
from slowtruth.session import materialize

WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1
#: Texts are hashed in pieces of about so many bytes; suffix arrays are built over about so many.
HASH_BYTES, SORT_BYTES = 1 << 20, 1 << 18
#: Anchors of a task of step 1 and bytes of a task of step 3, for the number of buckets.
BUCKET_ANCHORS, BUCKET_BYTES = 2_000_000, 4 << 20
#: Text of a pack, and bytes of stretches that are hashed at a time in step 3.
PACK_BYTES, BLOCK_BYTES = 4 << 20, 1 << 20
#: An anchor of more texts is dealt by window: sorting takes some 20 KB for each different stretch.
HOT_HOLDERS = 8192
PRIME = 0x9E3779B97F4A7C15
NULL_ID = np.iinfo(np.int64).min
#: The bits of an anchor's hash that are sent to find shared ones.
KNOWN = np.uint64(2**64 - 2**16)


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Suffix array of an integer string whose last symbol is its only smallest one."""
    n = len(symbols)
    first = np.argsort(symbols, kind="stable")
    ranked = symbols[first]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    table = np.zeros((3, n + 1), np.int64)
    table[0, starts] = sizes
    table[1, first], table[2, first] = np.repeat(starts, sizes), np.arange(n)
    # a group is named by its first place; its suffixes stand anywhere inside its places
    at, (size, group, place) = first.tolist(), table.tolist()
    smaller = [-1] * n

    end = n
    while end > 0:
        start = group[at[end - 1]]
        if end - start == 1:
            i = at[start]
            p = i - 1
            while p >= 0 and group[p] > start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                home = group[p]
                rest = size[home] - 1
                if rest:  # its group splits: p alone goes up
                    top, here = home + rest, place[p]
                    other = at[top]
                    at[here], at[top], place[other], place[p] = other, p, here, top
                    size[home], size[top], group[p] = rest, 1, top
            end = start
            continue
        members = at[start:end]
        members.sort()
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        end = start
        # what is followed by the group's string more often is larger, so it goes up first
        for k in sorted(set(times.values()), reverse=True):
            up = [p for p, c in times.items() if c == k]
            homes = [group[p] for p in up]
            for p, home in zip(up, homes):
                rest = size[home] = size[home] - 1
                top, here = home + rest, place[p]
                if here != top:
                    other = at[top]
                    at[here], at[top], place[other], place[p] = other, p, here, top
            for p, new in zip(up, [home + size[home] for home in homes]):
                group[p] = new
                size[new] += 1

    order, free, done = [n - 1] * n, list(range(n)), bytearray(n)
    done[n - 1] = 1
    for r in range(n):
        i = order[r] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            order[free[g]] = i
            free[g] += 1
            done[i] = 1
            i = smaller[i]
    return order


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on; the last GRAM - 1 positions have none."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(PRIME)
    powers, parts, size, power = GRAM, [], 1, PRIME
    # lengths 1, 2, 4, ...: those in GRAM's binary form are chained
    while powers:
        if powers & 1:
            parts.append((size, h, power))
        powers >>= 1
        if powers:
            h = h[:-size] * np.uint64(power) + h[size:]
            size, power = size * 2, power * power % 2**64
    total, out, offset = len(data) - GRAM + 1, None, 0
    for length, values, power in reversed(parts):
        piece = values[offset : offset + total]
        out = piece.copy() if out is None else out * np.uint64(power) + piece
        offset += length
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out | np.uint64(1)


class Anchors:
    """Anchors of some texts: ``at`` (position in the joined bytes), ``text`` (its number), ``hash``."""

    def __init__(self, texts: list[bytes]):
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)
        self.joined = b"".join(texts)
        self.at = self.text = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if len(self.joined) < WINDOW:
            self.lowest = np.zeros(0, np.uint64)
            return
        hashes = gram_hashes(np.frombuffer(self.joined, np.uint8))
        low = sliding(hashes, SPAN, np.minimum)
        # windows that leave their text do not count
        for end in self.ends[:-1]:
            low[max(0, end - WINDOW + 1) : end] = 0
        self.lowest = low
        pad = np.zeros(SPAN - 1, np.uint64)
        high = sliding(np.concatenate((pad, low, pad)), SPAN, np.maximum)
        self.at = np.flatnonzero(high == hashes)
        self.hash = hashes[self.at]
        self.text = np.searchsorted(self.ends, self.at, "right")

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window inside a text, in order: where it starts, and the number of its (leftmost) anchor."""
        starts = np.flatnonzero(self.lowest)
        own = np.searchsorted(self.at, starts)
        while True:
            wrong = np.flatnonzero(self.hash[own] != self.lowest[starts])
            if not len(wrong):
                return starts, own
            own[wrong] += 1


def pieces(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def fresh(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where another value of the columns begins in that order."""
    out = np.zeros(len(order), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[order[1:]] != c[order[:-1]]
    return out


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def counting(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the numbers."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def sliced(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``data``, one after another."""
    return data[np.repeat(begin, sizes) + counting(sizes)]


def narrow(h: np.ndarray) -> bytes:
    """Hashes without their last 16 bits, which serve to find what may be shared.

    The upper halves of sorted hashes are sent as compressed differences: about four bytes a hash instead of eight.
    """
    import zstandard

    steps = np.diff((h >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
    lower = (h >> np.uint64(16)).astype(np.uint16).tobytes()
    return len(h).to_bytes(8, "little") + lower + zstandard.ZstdCompressor(level=1).compress(planes)


def widened(raw: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 + 2 * n :]), np.uint8).reshape(4, n)
    upper = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)
    return (upper.astype(np.uint64) << np.uint64(32)) | (np.frombuffer(raw, np.uint16, n, 8).astype(np.uint64) << np.uint64(16))


def binaries(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def anchor_packs(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, anchors, owner, texts) from (a, text): sorted anchor hashes, and which of ``texts`` holds each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first = np.unique(batch.column("a").to_numpy(), return_index=True)
            texts = batch.column("text").take(pa.array(first)).to_pylist()
            hashes, owners = [], []
            for lo, hi in pieces(texts, HASH_BYTES):
                found = Anchors(texts[lo:hi])
                hashes.append(found.hash & KNOWN)
                owners.append(found.text + lo)
            if not hashes:
                continue
            h, own = np.concatenate(hashes), np.concatenate(owners)
            bucket = ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((own, h, bucket))
            h, own = h[order], own[order]
            keep = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))[: len(h)]
            h, own = h[keep], own[keep].astype(np.uint32 if len(keys) > 65535 else np.uint16)
            bucket = bucket[order][keep]
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)])) if len(h) else np.zeros(1, int)
            names = []
            for a, b in zip(cuts[:-1], cuts[1:]):  # the pack's own numbering of the texts it mentions
                used, own[a:b] = np.unique(own[a:b], return_inverse=True)
                names.append(keys[used].tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[cuts[:-1]] if len(h) else [], pa.int64()), pa.array([narrow(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                pa.array(binaries(own, cuts), pa.binary()), pa.array(names, pa.binary())],
                names=["bucket", "anchors", "owner", "texts"])

    return rows.mapInArrow(run, "bucket long, anchors binary, owner binary, texts binary")


def shared_anchors(packs: DataFrame, buckets: int, hot_holders: int = HOT_HOLDERS) -> DataFrame:
    """(a, shared, hot): of each text, the hashes of its anchors that another text holds too, and that very many hold.

    Buckets of anchors answer in packs for buckets of texts, not with a row for each text that they know.
    """
    def run(table: pa.Table) -> pa.Table:
        h, text = [], []
        for anchors, owner, texts in zip(*[table[c].to_pylist() for c in ("anchors", "owner", "texts")]):
            h.append(widened(anchors))
            kind = np.uint16 if len(owner) == 2 * len(h[-1]) else np.uint32
            text.append(np.frombuffer(texts, np.int64)[np.frombuffer(owner, kind)])
        h, text = np.concatenate(h), np.concatenate(text)
        order = np.lexsort((text, h))
        h, text = h[order], text[order]
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
        h, text = h[keep], text[keep]
        twin = np.concatenate(([False], h[1:] == h[:-1]))
        twin[:-1] |= twin[1:].copy()
        h, text = h[twin], text[twin]
        holders = np.diff(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))) if len(h) else np.zeros(0, np.int64)
        hot = np.repeat(holders > hot_holders, holders)
        to = text % buckets
        order = np.lexsort((text, to))
        h, text, to, hot = h[order], text[order], to[order], hot[order]
        cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
        edges = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
        inner = np.searchsorted(edges, cuts)
        return pa.table({
            "to": pa.array(to[cuts[:-1]], pa.int64()), "texts": pa.array(binaries(text[edges[:-1]], inner), pa.binary()),
            "counts": pa.array(binaries(np.diff(edges).astype(np.int32), inner), pa.binary()),
            "anchors": pa.array([narrow(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()), "hot": pa.array(binaries(hot, cuts), pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
        text = np.repeat(np.frombuffer(b"".join(table["texts"].to_pylist()), np.int64), counts)
        h = np.concatenate([widened(x) for x in table["anchors"].to_pylist()]).view(np.int64)
        hot = np.frombuffer(b"".join(table["hot"].to_pylist()), bool)
        order = np.argsort(text, kind="stable")
        h, text, hot = h[order], text[order], hot[order]
        ends = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1], [True])))
        return pa.table({"a": pa.array(text[ends[:-1]], pa.int64()),
                         "shared": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h)),
                         "hot": pa.ListArray.from_arrays(
                             pa.array(np.concatenate(([0], np.cumsum(hot)))[ends].astype(np.int32)), pa.array(h[hot]))})

    answers = packs.groupBy("bucket").applyInArrow(run, "to long, texts binary, counts binary, anchors binary, hot binary")
    return answers.groupBy("to").applyInArrow(gather, "a long, shared array<long>, hot array<long>")


def stretches(held: DataFrame, buckets: int, text: str) -> DataFrame:
    """Messages of stretches of shared anchors, from (pack, blob) with the columns key, text, shared and hot in each pack.

    (bucket, pack, anchor, id, row, start, windows, offset, stretch): each list has an entry for a stretch, except ``stretch``,
    their bytes one after another, compressed: ``windows`` + 49 of each. ``offset`` is where the anchor stands in it.

    A stretch that a smaller id of the same pack holds too is lost at once. Neighbouring ones come as one run of windows
    without bytes, in a message of a negative bucket.

    A stretch of a hot anchor comes as its windows, each with a hash of its 50 bytes for its anchor.
    """
    lists = {"anchor": np.int64, "id": np.int64, "row": np.int32, "start": np.int32, "windows": np.int32, "offset": np.int32}

    def message(number: int, buckets: list, cuts: np.ndarray, columns: list, bodies: list[bytes]) -> pa.RecordBatch:
        arrays = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(c.astype(t))) for c, t in zip(columns, lists.values())]
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int64()), pa.array([number] * len(buckets), pa.int64()), *arrays, pa.array(bodies, pa.binary())],
            names=["bucket", "pack", *lists, "stretch"])

    def held_before(anchor: np.ndarray, digests: list, ids: np.ndarray) -> np.ndarray:
        """Which of the strings a smaller id holds too."""
        order, _, later, _ = first_holders(ids, anchor, digests)
        out = np.empty(len(ids), bool)
        out[order] = later
        return out

    def runs(number, lost: np.ndarray, anchor, ids, row, start, n, offset) -> pa.RecordBatch:
        from pyspark import TaskContext

        x = np.flatnonzero(lost)  # stretches stand in the order of their texts
        joins = (row[x][1:] == row[x][:-1]) & (start[x][1:] == (start + n)[x][:-1])
        head = np.flatnonzero(np.concatenate(([True], ~joins)))
        total = np.add.reduceat(n[x], head)
        x = x[head]
        return message(number, [-1 - TaskContext.get().partitionId()], np.array([0, len(x)]), [anchor[x], ids[x], row[x], start[x], total, offset[x]], [b""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=1)
        for messages in batches:
            for number, blob in zip(messages.column("pack").to_pylist(), messages.column("blob")):
                yield from cut_pack(number, opened(blob.as_py()), small)

    def cut_pack(number: int, batch: pa.RecordBatch, small) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch, text)
        # all texts that hold a shared anchor have it among theirs, so one list for the pack does
        wanted = np.unique(batch.column("shared").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        whole, base = np.frombuffer(b"".join(texts), np.uint8), 0
        got: list[list] = [[] for _ in range(8)]
        for lo, hi in pieces(texts, HASH_BYTES):
            found = Anchors(texts[lo:hi])
            starts, own = found.owners()
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))[: len(own)]
            count = np.diff(np.concatenate((first, [len(own)])))
            keep = member(found.hash[own[first]] & KNOWN, wanted) if len(first) else np.zeros(0, bool)
            mine, at, n = own[first][keep], starts[first][keep], count[keep]
            text_ = found.text[mine]
            data = whole[base : base + len(found.joined)]
            digests = [Ranges(data, k).hashes(at, at + n + WINDOW - 1) for k in (0, 1)]
            for values, new in zip(got, (found.hash[mine].view(np.int64), text_ + lo, at - found.starts[text_], n, found.at[mine] - at, at + base, *digests)):
                values.append(new)
            base += len(data)
        if not sum(map(len, got[0])):
            return
        anchor, row, start, n, offset, place, *digests = [np.concatenate(v) for v in got]
        ids = batch.column("key").to_numpy()[row]
        lost = held_before(anchor, digests, ids)
        if lost.any():
            yield runs(number, lost, anchor, ids, row, start, n, offset)
        hot = member(anchor & KNOWN.view(np.int64), np.unique(batch.column("hot").flatten().to_numpy(zero_copy_only=False))) & ~lost
        stay = np.flatnonzero(~(lost | hot))
        if hot.any():
            x = np.flatnonzero(hot)
            of, shift = np.repeat(x, n[x]), counting(n[x])
            single = sliced(whole, place[of] + shift, np.full(len(of), WINDOW))
            cuts = np.arange(len(of) + 1) * WINDOW
            names = [Ranges(single, k).hashes(cuts[:-1], cuts[1:]) for k in (0, 1)]
            windows = (names[0].view(np.int64), ids[of], row[of], start[of] + shift, np.ones(len(of), np.int64), offset[of] - shift)
            gone = held_before(windows[0], names, ids[of])
            if gone.any():
                yield runs(number, gone, *windows)
            left = np.flatnonzero(~gone)
            anchor, ids, row, start, n, offset, place = [
                np.concatenate((c[stay], w[left])) for c, w in zip((anchor, ids, row, start, n, offset, place), (*windows, place[of] + shift))]
            stay = np.arange(len(anchor))
        bucket = (anchor.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = stay[np.lexsort((anchor[stay], bucket[stay]))]
        bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(order) else np.zeros(1, np.int64)
        sizes = n + WINDOW - 1
        bodies = [small.compress(sliced(whole, place[order[p:q]], sizes[order[p:q]]).tobytes()) for p, q in zip(cuts[:-1], cuts[1:])]
        yield message(number, bucket[cuts[:-1]].tolist(), cuts, [c[order] for c in (anchor, ids, row, start, n, offset)], bodies)

    schema = "bucket long, pack long, anchor array<long>, id array<long>, row array<int>, start array<int>, windows array<int>, offset array<int>, stretch binary"
    return held.mapInArrow(run, schema)


def lost_windows(joined: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different stretches, one after another: runs of windows that a stretch of a smaller id holds (stretch, first, last + 1)."""
    n = len(joined) + len(lengths)
    begin = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    symbols = np.ones(n + 1, np.int64)  # 1 ends every stretch, below all bytes, and 0 all of them
    inside = np.ones(n, bool)
    inside[begin + lengths] = False
    symbols[:-1][inside] = joined.astype(np.int64) + 2
    symbols[-1] = 0
    order = np.array(suffix_array(symbols))
    # only suffixes that start a window
    offset = np.arange(n) - begin[owner]
    order = order[order < n]
    order = order[offset[order] <= lengths[owner[order]] - WINDOW]
    narrow = symbols.astype(np.int16)
    same = np.ones(len(order) - 1, bool)
    for k in range(WINDOW):
        column = narrow[order + k]
        same &= column[1:] == column[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    smallest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, ids[owner[order]])
    lost = ids[owner[order]] > smallest[group]
    out = np.zeros(n + 2, np.int8)
    out[order[lost] + 1] = 1
    edge = np.diff(out)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    which = owner[first] if len(first) else first
    return which, first - begin[which], last - begin[which]


def may_share(data: np.ndarray, anchor: np.ndarray, begin: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which stretches of ``data`` may have a window in common with another one of their anchor (at ``at`` in each).

    A window is the anchor, r bytes after it and 26 - r before. For r from t to t + 3, two stretches that share the window
    are equal from 23 - t bytes before the anchor to t bytes after it. What is alone for every t is not sorted.
    """
    near, out = Ranges(data, 2), np.zeros(len(anchor), bool)
    for t in range(0, SPAN, 4):
        before = max(0, SPAN - 4 - t)
        fit = np.flatnonzero((at >= before) & (sizes >= at + GRAM + t))
        keys = near.hashes((begin + at)[fit] - before, (begin + at)[fit] + GRAM + t)
        out[fit] |= several(combined(anchor[fit].view(np.uint64), keys))
    return out


def first_holders(ids: np.ndarray, anchor: np.ndarray, digests: list[np.ndarray]) -> tuple:
    """Equal strings of an anchor: (order that brings them together, where each begins, later, firsts).

    The smallest id comes first; ``later`` are those in order that a larger id holds, ``firsts`` how many of each have the smallest.
    """
    order = np.lexsort((ids, *digests, anchor))
    head = np.flatnonzero(fresh(order, anchor, *digests))
    group = np.repeat(np.arange(len(head)), np.diff(np.concatenate((head, [len(order)]))))
    later = ids[order] > ids[order][head][group]
    return order, head, later, np.bincount(group[~later], minlength=len(head))


def several(keys: np.ndarray) -> np.ndarray:
    """Which values stand more than once."""
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[back] > 1


def later_windows(messages: DataFrame, sort_bytes: int = SORT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(pack, row, start, length): runs of bytes whose windows a smaller id holds, in the stretches of each bucket.

    Equal stretches are one. Of what is left, windows that stand alone by their hash are cut off, and equal runs of the others
    are one again. Suffix arrays tell the windows of those runs apart that still share one with a different run.
    """
    def run(table: pa.Table) -> pa.Table:
        import zstandard

        flat = {c: table[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("anchor", "id", "row", "start", "windows", "offset")}
        flat["pack"] = np.repeat(table["pack"].to_numpy(), pc.list_value_length(table["anchor"]).to_numpy())
        sizes = flat["windows"] + WINDOW - 1
        if table["bucket"][0].as_py() < 0:
            return pa.table({"pack": flat["pack"], "row": flat["row"], "start": flat["start"], "length": sizes})
        unpack = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(unpack.decompress(x) for x in table["stretch"].to_pylist()), np.uint8)
        begin = np.cumsum(sizes) - sizes
        # whole anchors at a time, so that the hashes of a block fit the task whatever the bucket holds
        order = np.argsort(flat["anchor"], kind="stable")
        spent, known, lo, found = np.cumsum(sizes[order]), flat["anchor"][order], 0, []
        while lo < len(order):
            over = int(np.searchsorted(spent, (spent[lo - 1] if lo else 0) + block_bytes))
            hi = int(np.searchsorted(known, known[min(over, len(order) - 1)], "right"))
            x = order[lo:hi]
            which, first, length = lost_runs(sliced(data, begin[x], sizes[x]), *(flat[c][x] for c in ("anchor", "id", "windows", "offset")), sort_bytes)
            found.append((x[which], first, length))
            lo = hi
        x, first, length = (np.concatenate(c) for c in zip(*found))
        return pa.table({"pack": flat["pack"][x], "row": flat["row"][x], "start": flat["start"][x] + first, "length": length})

    return messages.groupBy("bucket").applyInArrow(run, "pack long, row long, start long, length long")


def lost_runs(data: np.ndarray, anchor: np.ndarray, id_: np.ndarray, windows: np.ndarray, offset: np.ndarray, sort_bytes: int):
    """Of stretches, one after another in ``data``: (stretch, first byte, bytes) of what a smaller id holds too."""
    sizes = windows + WINDOW - 1
    begin = np.cumsum(sizes) - sizes
    bodies = [Ranges(data, k) for k in (0, 1)]
    rows, starts, lengths = [], [], []

    def lose(stretch: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Bytes of distinct stretches that go, in all rows of the smallest id."""
        times = firsts[stretch]
        rows.append(order[np.repeat(head[stretch], times) + counting(times)])
        starts.append(np.repeat(first, times))
        lengths.append(np.repeat(size, times))

    order, head, later, firsts = first_holders(id_, anchor, [b.hashes(begin, begin + sizes) for b in bodies])
    rows.append(order[later])
    starts.append(np.zeros(len(rows[0]), np.int64))
    lengths.append(sizes[rows[0]])
    one = order[head]
    asked = np.flatnonzero(may_share(data, anchor[one], begin[one], sizes[one], offset[one]))
    x = one[asked]
    own = np.repeat(np.arange(len(x)), windows[x])
    place = begin[x][own] + counting(windows[x])
    key = combined(anchor[x][own].view(np.uint64), Ranges(data, 3).hashes(place, place + WINDOW))
    shared = several(key)
    breaks = own[1:] != own[:-1]
    from_ = np.flatnonzero(shared & np.concatenate(([True], ~shared[:-1] | breaks))[: len(own)])
    to = np.flatnonzero(shared & np.concatenate((~shared[1:] | breaks, [True]))[: len(own)])
    stretch, at, size = asked[own[from_]], place[from_], to - from_ + WINDOW
    first, holder, of = at - begin[one[stretch]], id_[one[stretch]], anchor[one[stretch]]
    order2, head2, later2, firsts2 = first_holders(holder, of, [b.hashes(at, at + size) for b in bodies])
    gone = order2[later2]
    lose(stretch[gone], first[gone], size[gone])
    runs = order2[head2]
    count = size[runs] - WINDOW + 1
    again = several(key[np.repeat(from_[runs], count) + counting(count)])
    left = np.unique(np.repeat(np.arange(len(runs)), count)[again])
    # whole anchors are sorted in blocks
    spent, known, lo = np.cumsum(size[runs[left]]), of[runs[left]], 0
    while lo < len(left):
        over = int(np.searchsorted(spent, (spent[lo - 1] if lo else 0) + sort_bytes))
        hi = int(np.searchsorted(known, known[min(over, len(left) - 1)], "right"))
        block = left[lo:hi]
        y = runs[block]
        which, p, q = lost_windows(sliced(data, at[y], size[y]), size[y], holder[y])
        times = firsts2[block[which]]
        same = order2[np.repeat(head2[block[which]], times) + counting(times)]
        lose(stretch[same], first[same] + np.repeat(p, times), np.repeat(q - p + WINDOW - 1, times))
        lo = hi
    return tuple(np.concatenate(c) for c in (rows, starts, lengths))


def drop_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sort_bytes: int = SORT_BYTES,
                        hot_holders: int = HOT_HOLDERS) -> DataFrame:
    """All rows of ``docs`` with ``kept_bytes`` (binary), ``n_bytes``, ``n_removed`` and ``spans``.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. ``spans`` are the
    maximal runs of such bytes (start and length, in bytes of the UTF-8 text). What is left may cut a character in two,
    therefore it is binary. Strings are judged on the input.

    Ids are whole numbers. Null ids are one document before all others. Null texts are empty; texts under 50 bytes lose
    nothing. Rows with the same id are one document: they take nothing from each other. An empty table gives an
    empty table.
    """
    names = docs.columns
    id_at, text_at = f"_{position(docs, doc_id)}", f"_{position(docs, text)}"
    raw = F.coalesce(F.encode(F.col(text_at), "UTF-8"), F.lit(b""))
    rows = numbered(docs).withColumns({
        "key": F.coalesce(F.col(id_at).cast("long"), F.lit(int(NULL_ID))), "raw": raw})
    rows = rows.withColumns({"a": F.xxhash64("raw"), "b": F.xxhash64(F.lit("second"), "raw")})
    texts = materialize(rows.groupBy("a", "b").agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("n"), F.first(F.octet_length("raw")).cast("long").alias("size")), "texts")
    total = texts.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, int(total * 2 / (SPAN + 1) // BUCKET_ANCHORS) + 1)
    sent = anchor_packs(rows.where(F.octet_length("raw") >= WINDOW).select("a", F.col("raw").alias("text")), buckets)
    shared = shared_anchors(sent, buckets, hot_holders)
    info = materialize(texts.join(shared, "a", "left").where("n > 1 OR shared IS NOT NULL")
                       .select("a", "b", "first", "shared", "hot"), "shared-anchors")
    # texts meet what is known of them once; from here on only the ones with shared anchors move
    told = rows.drop("raw").join(info, ["a", "b"], "left")
    told = materialize(told.withColumns({
        "copy": F.coalesce(F.col("first") < F.col("key"), F.lit(False)),
        "open": F.coalesce((F.col("first") == F.col("key")) & (F.size("shared") > 0), F.lit(False)),
    }).withColumns({c: F.when(F.col("open"), F.col(c)) for c in ("shared", "hot")}).drop("first"), "told", ["open"], compression="zstd")
    asked = told.where("open")
    work = asked.agg(F.sum(F.size("shared") * (WINDOW + SPAN // 2) + F.size("hot") * SPAN * WINDOW)).first()[0] or 0
    # near copies share their lowest anchor, so that most equal stretches meet before they are shuffled
    near = asked.withColumn("low", F.array_min("shared")).repartitionByRange("low", "key").sortWithinPartitions("low", "key")
    columns = [f"_{i}" for i in range(len(names))]
    held = materialize(packs(near.select(*columns, "key", "shared", "hot"), text_at, PACK_BYTES), "packs", compression="uncompressed")
    lost = later_windows(stretches(held, max(1, int(work // BUCKET_BYTES) + 1), text_at), sort_bytes)
    by_pack = lost.groupBy("pack").agg(F.collect_list(F.struct("row", "start", "length")).alias("lost"))
    found = held.join(by_pack.hint("merge"), "pack", "left")
    # the others: unique, or copies of a text with a smaller id
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(text_at).cast("long").alias("length")))
    rest = told.where("NOT open").select(*columns, F.when(F.col("copy") & (F.octet_length(text_at) >= WINDOW), whole).alias("lost"))

    def cut_out(texts: list, lost: list) -> list[list]:
        kept, size, gone, spans = [], [], [], []
        for t, runs in zip(texts, lost):
            raw = (t or "").encode("utf-8", "replace")
            merged: list[list[int]] = []
            for s, n in sorted((r["start"], r["length"]) for r in runs or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s + n)
                else:
                    merged.append([s, s + n])
            edges = [0, *[x for run in merged for x in run], len(raw)]
            kept.append(b"".join(raw[p:q] for p, q in zip(edges[::2], edges[1::2])))
            size.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            spans.append([{"start": s, "length": e - s} for s, e in merged])
        return [kept, size, gone, spans]

    fields = [("kept_bytes", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("spans", "array<struct<start:long,length:long>>")]
    others = map_batches(rest, [text_at, "lost"], cut_out, fields).drop("lost")
    kinds = to_arrow_schema(others.schema)

    def cut_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, lost in zip(batch.column("blob"), batch.column("lost").to_pylist()):
                inner = opened(blob.as_py())
                own: list[list] = [[] for _ in range(inner.num_rows)]
                for x in lost or ():
                    own[x["row"]].append(x)
                new = cut_out(inner.column(text_at).to_pylist(), own)
                arrays = [inner.column(c) for c in columns] + [pa.array(v, kinds.field(n).type) for (n, _), v in zip(fields, new)]
                yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

    return restored(found.mapInArrow(cut_packs, others.schema).unionByName(others), names, [n for n, _ in fields])


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every whole document that a document with a smaller id holds in 50 bytes or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept_bytes", 256).alias("kept_sha256"))
