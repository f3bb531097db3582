"""Conversation structure repair: the cheapest edits that make every conversation ``(s?(ua)+)?``, with an audit of them.

Rows are sorted by (conversation, turn) across the cluster and cut into blocks, so that no conversation has to fit a task.

1. Rows seen earlier in their conversation are found by the first place of each (role, text).
2. A block is summed up for each state it may be entered and left in (nothing yet, after the system row, after a user's, after an
   assistant's): the cheapest edits, and of the cheapest the ASCII-least. Edit strings share their prefixes as linked nodes with
   binary-lifting ancestors and rolling hashes; ties go by the longest common prefix, and equal hashes are verified.
3. The blocks of a conversation are folded in order; what is kept of them is four ways, linked in the same manner.
4. Each block meets the way chosen for it, and its rows stream past with their edits.

Equal costs and rows never leave one string the beginning of another: what is longer has one more insertion, which costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtruth.llm.common import SPACES, numbered, position, restored, take
from slowtruth.operators.scan import BLOCK, KEY, ROW, stage_order, with_block

BLOCK_BITS = 12
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Of a row: the initial of its role (0 is any other), and what it costs.
KINDS = {"s": 1, "u": 2, "a": 3}
MUST_GO, CUT_SHORT = 4, 8
#: States: nothing yet, after system, after user, after assistant. From each, one of user and assistant may follow.
STATES, NEXT = range(4), (2, 2, 3, 2)
FINAL = (0, 3)
KEEP = {1: {0: 1}, 2: {0: 2, 1: 2, 3: 2}, 3: {2: 3}}
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E680F


class Edits:
    """Edit strings as nodes: each has its parent, its last piece and its ancestors 1, 2, 4, ... nodes back.

    ``hash`` is a rolling hash of the string from the root on; strings that begin alike share their nodes.
    """

    def __init__(self):
        self.piece, self.depth, self.hash, self.size, self.up = [""], [0], [0], [0], [[]]

    def append(self, node: int, piece: str) -> int:
        up, j = [node], 0
        while len(self.up[up[j]]) > j:
            up.append(self.up[up[j]][j])
            j += 1
        self.up.append(up)
        self.piece.append(piece)
        self.depth.append(self.depth[node] + 1)
        self.size.append(self.size[node] + len(piece))
        h = self.hash[node]
        for c in piece:
            h = (h * _BASE + ord(c)) % _PRIME
        self.hash.append(h)
        return len(self.piece) - 1

    def at_depth(self, node: int, depth: int) -> int:
        back = self.depth[node] - depth
        while back:
            j = back.bit_length() - 1
            node = self.up[node][j]
            back -= 1 << j
        return node

    def alike(self, x: int, y: int) -> bool:
        """Whether the strings are equal: by hash, then verified back to the node they share."""
        if x == y:
            return True
        if self.hash[x] != self.hash[y] or self.size[x] != self.size[y]:
            return False
        a, b = "", ""
        while x != y:
            if len(a) <= len(b):
                a, x = self.piece[x] + a, self.up[x][0]
            else:
                b, y = self.piece[y] + b, self.up[y][0]
            n = min(len(a), len(b))
            if n and a[-n:] != b[-n:]:
                return False
            a, b = (a[:-n], b[:-n]) if n else (a, b)
        return a == b

    def less(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` comes before that of ``y``: a search for their longest common prefix."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.at_depth(x, depth), self.at_depth(y, depth)
        if not self.alike(a, b):
            for j in range(depth.bit_length() - 1, -1, -1):
                if j < len(self.up[a]) and not self.alike(self.up[a][j], self.up[b][j]):
                    a, b = self.up[a][j], self.up[b][j]
            depth = self.depth[a] - 1
        # from here on the pieces differ, or one string is at its end
        s, t, i, j = "", "", depth, depth
        while True:
            n = min(len(s), len(t))
            if s[:n] != t[:n]:
                return s[:n] < t[:n]
            s, t = s[n:], t[n:]
            if not s and i < self.depth[x]:
                i += 1
                s = self.piece[self.at_depth(x, i)]
            elif not t and j < self.depth[y]:
                j += 1
                t = self.piece[self.at_depth(y, j)]
            elif not s or not t:
                return not s and bool(t)

    def spelled(self, node: int) -> str:
        return "".join(self.pieces(node))

    def pieces(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.piece[node])
            node = self.up[node][0]
        return out[::-1]


Ways = dict[int, tuple[int, int]]  # of a state: the least cost to come there, and the edits


def offer(edits: Edits, ways: Ways, state: int, cost: int, node: int, piece: str) -> bool:
    held = ways.get(state)
    if held is not None and held[0] < cost:
        return False
    new = edits.append(node, piece) if piece else node
    if held is not None and held[0] == cost and not edits.less(new, held[1]):
        return False
    ways[state] = cost, new
    return True


def with_insertions(edits: Edits, ways: Ways) -> Ways:
    """The ways after any insertions: costs rise with each, so that three rounds reach every state."""
    out = dict(ways)
    for _ in range(3):
        if not any([offer(edits, out, NEXT[s], out[s][0] + INSERT, out[s][1], "I") for s in list(out)]):
            break
    return out


def step(edits: Edits, ways: Ways, code: int) -> Ways:
    """The ways after one more row."""
    ready, out = with_insertions(edits, ways), {}
    for s, (cost, node) in ready.items():
        offer(edits, out, s, cost + DELETE, node, "D")
        if not code & MUST_GO:
            late = TRUNCATED if code & CUT_SHORT else 0
            to = KEEP.get(code & 3, {}).get(s)
            if to is not None:
                offer(edits, out, to, cost + late, node, "K")
            offer(edits, out, NEXT[s], cost + REROLE + late, node, "R")
    return out


@lru_cache(maxsize=50_000)
def summary(codes: bytes) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs and edits of a block from each state (rows) to each state (columns); a cost of -1 where none leads."""
    costs, strings = [], []
    for entry in STATES:
        edits = Edits()
        ways: Ways = {entry: (0, 0)}
        for code in codes:
            ways = step(edits, ways, code)
        for s in STATES:
            costs.append(ways[s][0] if s in ways else -1)
            strings.append(edits.spelled(ways[s][1]) if s in ways else "")
    return tuple(costs), tuple(strings)


def chosen(blocks: list[tuple[list, list]]) -> tuple[list[tuple[int, str]], int]:
    """Of a conversation's blocks in order: (entry state, edits) of each, and how many insertions follow the last one."""
    edits = Edits()
    ways: Ways = {0: (0, 0)}
    back: dict[int, int] = {}  # the state that a node was entered from
    for costs, strings in blocks:
        after: Ways = {}
        for s, (cost, node) in ways.items():
            for t in STATES:
                if costs[4 * s + t] >= 0 and offer(edits, after, t, cost + costs[4 * s + t], node, strings[4 * s + t]):
                    back[after[t][1]] = s
        ways = after
    ended = with_insertions(edits, ways)
    best = None
    for s in FINAL:
        if s in ended and (best is None or ended[s][0] < best[0] or ended[s][0] == best[0] and edits.less(ended[s][1], best[1])):
            best = ended[s]
    pieces, node = [], best[1]
    while edits.depth[node]:
        pieces.append((back.get(node), edits.piece[node]))
        node = edits.up[node][0]
    pieces.reverse()
    return pieces[: len(blocks)], len(pieces) - len(blocks)


def _streamed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of a sorted stream, grouped by neighbouring equal keys; a group is not gathered."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
    return groupby(rows, key=lambda row: row[: len(keys)])


def repair_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         bits: int = BLOCK_BITS) -> DataFrame:
    """The log of all edits: a row for each row of ``df`` and each insertion, in the order of (``place``, ``step``).

    Rows of a conversation go by turn, nulls first; rows of one turn by role and text. Null roles and texts count as one space.
    ``fault`` is the first that a row has: ``blank`` (no character but ASCII white space), ``duplicate`` (role and text stand
    earlier), ``truncated`` (the last other character is none of ``.!?``). ``edit`` is K (keep, 0), R (other role, 2), D
    (delete, 3; the only one for blank and duplicate rows) or I (an empty text, 2); a truncated row that stays costs 1 more. The cheapest edits
    are taken that leave an optional system row and then pairs of user and assistant, or nothing, told by the first letters of
    the roles (an empty role has none and cannot be kept); of the cheapest the ASCII-least. ``role`` and ``text`` are those after the edit, ``was`` is the role before.

    Null conversation ids are one conversation. Repeated rows are duplicates. Other columns stay with their rows and are null for insertions. Any
    order of equal rows gives the same log. An empty table gives an empty one. The edits of a conversation (a byte for each) have to fit a task.
    """
    names = df.columns
    conv_at, turn_at, role_at, text_at = (f"_{position(df, c)}" for c in (conv_id, turn, role, text))
    plain = numbered(df)
    plain = plain.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in (role_at, text_at)})
    # equal rows may go to several ranges; which of them comes first changes nothing
    plain = plain.withColumns({"head": F.substring(text_at, 1, 64), "tie": F.monotonically_increasing_id()})
    staged = stage_order(plain, [conv_at], [turn_at, role_at, "head", text_at, "tie"], "turns").drop("head", "tie")
    ink = F.rtrim(F.col(text_at), F.lit(SPACES))
    rows = with_block(staged, [conv_at], bits).withColumns({
        "ha": F.xxhash64(role_at, text_at), "hb": F.xxhash64(F.lit("second"), role_at, text_at)})
    seen = rows.groupBy(KEY, "ha", "hb").agg(F.min(ROW).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    initial = F.substring(role_at, 1, 1)
    kind = F.when(initial == "s", KINDS["s"]).when(initial == "u", KINDS["u"]).when(initial == "a", KINDS["a"]).otherwise(0)
    flagged = rows.select(
        KEY, BLOCK, ROW, "ha", "hb", kind.alias("kind"), (ink == "").alias("blank"), (~F.substring(ink, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).join(seen.hint("merge"), [KEY, "ha", "hb"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col(ROW) > F.col("earliest"), "duplicate").when(F.col("cut"), "truncated")
    flagged = flagged.select(KEY, BLOCK, ROW, "kind", fault.alias("fault"))
    code = F.col("kind") + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(0)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (key, block), own in _runs(batches, [KEY, BLOCK]):
            own = list(own)  # a block
            codes = bytes(r[3] for r in own)
            held.append((key, block, codes, *summary(codes)))
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=summed)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=summed)

    summed = [KEY, BLOCK, "codes", "costs", "strings"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
    blocks = _streamed(flagged.select(KEY, BLOCK, ROW, code.alias("code")), [KEY, BLOCK], [ROW]).mapInArrow(
        sum_up, f"{KEY} string, {BLOCK} long, codes binary, costs array<long>, strings array<string>")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), own in _runs(batches, [KEY]):
            parts = [r[1:] for r in own]
            ways, tail = chosen([(costs, strings) for _, _, costs, strings in parts])
            yield pa.RecordBatch.from_pydict({
                KEY: pa.array([key] * len(parts), pa.string()), BLOCK: pa.array([p[0] for p in parts], pa.int64()),
                "codes": pa.array([p[1] for p in parts], pa.binary()), "entry": pa.array([s for s, _ in ways], pa.int32()),
                "edits": pa.array([e for _, e in ways], pa.string()), "tail": pa.array([0] * (len(parts) - 1) + [tail], pa.int32())})

    ways = _streamed(blocks, [KEY], [BLOCK]).mapInArrow(fold, f"{KEY} string, {BLOCK} long, codes binary, entry int, edits string, tail int")
    told = rows.drop("ha", "hb").unionByName(ways.withColumn(ROW, F.lit(-1).cast("long")), allowMissingColumns=True)

    columns = [f"_{i}" for i in range(len(names))]
    fields = [T.StructField(c, staged.schema[c].dataType) for c in columns] + list(T._parse_datatype_string(
        "place long, step int, edit string, was string, fault string").fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way: Iterator[tuple] = iter(())
        ops, codes, tail, state, at = "", b"", 0, 0, 0
        for batch in batches:
            place, entry, edits, ends, bits_ = (batch.column(c).to_pylist() for c in (ROW, "entry", "edits", "tail", "codes"))
            roles = batch.column(role_at).to_pylist()
            from_row, of_row, out = [], [], []  # rows to take, the row an insertion stands beside, and the new columns
            for i, row in enumerate(place):
                if row < 0:
                    ops, codes, tail, state, at, k = edits[i], bits_[i], ends[i], entry[i], 0, 0
                    continue
                count = 0
                while True:
                    op = ops[at]
                    at += 1
                    if op == "I":
                        state = NEXT[state]
                        from_row.append(None)
                        out.append((row, count, "I", "user" if state == 2 else "assistant", "", None, None))
                    else:
                        code_, was = codes[k], roles[i]
                        k += 1
                        if op == "R":
                            state = NEXT[state]
                        elif op == "K":
                            state = KEEP[code_ & 3][state]
                        from_row.append(i)
                        new = ("user" if state == 2 else "assistant") if op == "R" else was
                        out.append((row, count, op, new, None, was, code_))
                    of_row.append(i)
                    count += 1
                    if op != "I":
                        break
                if at == len(ops):  # what is added at the end of the conversation
                    for _ in range(tail):
                        state = NEXT[state]
                        from_row.append(None)
                        of_row.append(i)
                        out.append((row, count, "I", "user" if state == 2 else "assistant", "", None, None))
                        count += 1
            if not out:
                continue
            rows_, beside = pa.array(from_row, pa.int64()), pa.array(of_row, pa.int64())
            where, steps, edit, new_role, new_text, was, code_ = zip(*out)
            arrays = []
            for c in columns:
                if c == conv_at:
                    arrays.append(batch.column(c).take(beside))
                elif c == role_at:
                    arrays.append(pa.array(new_role, pa.string()))
                elif c == text_at:
                    kept = batch.column(c).take(rows_)
                    arrays.append(kept.fill_null("") if kept.null_count else kept)
                else:
                    arrays.append(batch.column(c).take(rows_))
            arrays += [pa.array(where, pa.int64()), pa.array(steps, pa.int32()), pa.array(edit, pa.string()), pa.array(was, pa.string()), pa.array(code_, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "place", "step", "edit", "was", "code"])

    walked = T.StructType(fields[:-1] + [T.StructField("code", T.IntegerType())])
    log = _streamed(told, [KEY, BLOCK], [ROW]).mapInArrow(walk, walked)
    blank = F.rtrim(F.col(text_at), F.lit(SPACES)) == ""
    log = log.withColumn("fault", F.when(F.col("code").bitwiseAND(MUST_GO) > 0, F.when(blank, "blank").otherwise("duplicate"))
                         .when(F.col("code").bitwiseAND(CUT_SHORT) > 0, "truncated")).drop("code")
    return restored(log, names, ["place", "step", "edit", "was", "fault"])


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations, with one row in four damaged by the checksum of its id and turn.

    Nulls are one space, in the checksum too, but ids and turns stay null. Of 20 remainders 0 drops the row, 1 empties its text, 2 takes
    its sentence ends away, 3 repeats it, 4 makes it the user's.
    """
    rows = take(df, conv_id="conv_id", turn="turn", role="role", text="text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                       (F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20).alias("d"))
    rows = rows.where("d <> 0").select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("d") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def digests(log: DataFrame) -> DataFrame:
    """One row for each conversation of an edit log: its faults, cost, audit and the hash of its repaired rows.

    A conversation streams through one task in order, row by row; its audit is all that is held of it.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = T.StructType([log.schema["conv_id"], *T._parse_datatype_string(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list[tuple] = []

        def pack() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*held), [kind, *[pa.int64()] * 6, pa.string(), pa.string()])]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(1).type
                yield batch

        for (_, conv), own in _runs(typed(), [KEY, "conv_id"]):
            faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            low = high = last = before = None
            turns = illegal = cost = 0
            audit, digest, first = [], hashlib.sha256(), True
            for _, _, turn, edit, was, fault, role, text in own:
                audit.append(edit)
                if edit != "I":
                    if turn is not None and turn != last:
                        low, high, last, turns = turn if low is None else low, turn, turn, turns + 1
                    illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
                    before = was[:1]
                    if fault is not None:
                        faults[fault] += 1
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "D":
                    digest.update((("" if first else "\n") + f"{role}:{text}").encode())
                    first = False
            gaps = high - low + 1 - turns if turns else 0
            held.append((conv, gaps, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest()))
            if len(held) >= 1000:
                yield pack()
        if held:
            yield pack()

    rows = log.select(F.to_json(F.struct("conv_id")).alias(KEY), "conv_id", "turn", "edit", "was", "fault", "role", "text", "place", "step")
    order = _streamed(rows, [KEY], ["place", "step"]).drop("place", "step")
    return order.mapInArrow(run, schema)


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    """What the cheapest repair does to every conversation, after damage that the rows' checksums decide."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = digests(repair_conversations(damaged(talks))).withColumnRenamed("conv_id", "known")
    every = talks.select("conv_id").distinct()
    both = every.join(found.hint("merge"), every.conv_id.eqNullSafe(F.col("known")), "left").drop("known")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _more(way: str, cost: str, edit: str, line: str) -> str:
    """SQL: a way through the edits so far, with one more."""
    return f"{{'c': {way}.c + {cost}, 's': {way}.s || '{edit}', 'r': {way}.r || {line}}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _op11_sql() -> str:
    """A left fold over the rows of each conversation, a way for each state; the text repaired so far is part of it."""
    added = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}
    inserted = lambda way, role: _more(way, str(INSERT), "I", added[role])

    def after_row(to: str, initial: str, role: str, *ways: str) -> str:
        keep = [f"CASE WHEN NOT must AND initial = '{initial}' THEN {_more(w, 'late', 'K', 'chr(10) || role || chr(58) || text')} END" for w in ways]
        move = [] if initial == "s" else [
            f"CASE WHEN NOT must THEN {_more(w, f'late + {REROLE}', 'R', added[role] + ' || text')} END" for w in ways]
        return _least(_more(to, str(DELETE), "D", "''"), *keep, *move)

    start = lambda c: f"{{'c': {c}::BIGINT, 's': '', 'r': ''}}"
    return f"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
  h AS (SELECT DISTINCT key, 0 AS i, 4294967295::BIGINT AS crc FROM k
        UNION ALL SELECT key, i + 1, CASE WHEN (i + 1) % 9 = 1 THEN xor(crc, ascii(key[i // 9 + 1])::BIGINT)
            WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END
        FROM h WHERE i < 9 * length(key)),
  d AS (SELECT k.conv_id, k.turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN m = 1 THEN '' WHEN m = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM (SELECT k.*, xor(crc, 4294967295::BIGINT) % 20 AS m FROM k JOIN h ON h.key = k.key AND h.i = 9 * length(k.key)) k),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial FROM d),
  f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
               NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
  r AS (SELECT *, blank OR again AS must, (cut AND NOT blank AND NOT again)::INT AS late FROM f),
  a AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(late)::BIGINT AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
  w AS (SELECT conv_id, n, 0 AS i, {start(0)} AS w0, {start(10 ** 6)} AS w1, {start(10 ** 6)} AS w2, {start(10 ** 6)} AS w3 FROM a
        UNION ALL
        SELECT w.conv_id, n, i + 1,
               CASE WHEN r.pos IS NULL THEN w0 ELSE {after_row("w0", "s", "")} END,
               CASE WHEN r.pos IS NULL THEN w1 ELSE {after_row("w1", "s", "", "w0")} END,
               CASE WHEN r.pos IS NULL THEN {_least("w2", *[inserted(x, "user") for x in ("w0", "w1", "w3")])}
                    ELSE {after_row("w2", "u", "user", "w0", "w1", "w3")} END,
               CASE WHEN r.pos IS NULL THEN {_least("w3", inserted("w2", "assistant"))}
                    ELSE {after_row("w3", "a", "assistant", "w2")} END
        FROM w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND (w.i + 1) % 4 = 0 AND r.pos = (w.i + 1) // 4
        WHERE i < 4 * n + 3),
  e AS (SELECT conv_id, {_least("w0", "w3")} AS best FROM w WHERE i = 4 * n + 3)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.s, '') AS audit,
       sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _op11_sql()
