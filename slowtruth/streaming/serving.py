"""The live job: pair two streams with a time limit, then score and train per grade in the order of measurement.

Both steps keep their state in Spark's state store and use the same step code as the batch plans. Matched rows wait in the
state, in chunks by time, until the watermark says that no earlier row can come any more; then timers drain them in order.
Whatever the order of arrival, the rows are those of a batch run over the same pairs. What comes behind the watermark is
written as it is, with ``kind`` late, by the micro-batch that got it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from slowtruth.functions import expr
from slowtruth.operators.match import DEFAULT_TTL
from slowtruth.operators.models import KeyModels, Router, RulesAndRouter, Settings
from slowtruth.plans.evaluation import RESULT_COLUMNS, X
from slowtruth.session import materialize
from slowtruth.sources.events import decode_events, quarantine_events
from slowtruth.sources.sinks import read_live

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

PAIR_SCHEMA = (
    "slab_id string, pass_number int, status string, event_ts timestamp, a_at long, b_at long, "
    "steel_grade string, x array<double>, baseline double, actual double, wear_level double"
)
_PAIR_FIELDS = [part.strip().split(" ")[0] for part in PAIR_SCHEMA.split(",")]
#: Result rows, and after them what is known of an event that got none. Times are microseconds of the wall clock.
RESULT_SCHEMA = (
    "kind string, b_at long, a_at long, steel_grade string, slab_id string, pass_number int, "
    "baseline_roll_force_kn double, target_mean_roll_force_kn double, sgd_roll_force_kn double, "
    "am_rules_roll_force_kn double, actual_roll_force_kn double, baseline_ape double, target_mean_ape double, "
    "sgd_ape double, am_rules_ape double, am_rules_shadow_ape double, wear_level double, is_am_rules_fallback int"
)


_RESULT_FIELDS = [part.strip().split(" ")[0] for part in RESULT_SCHEMA.split(",")]


def use_stream_settings(spark: SparkSession) -> None:
    for name, value in STREAM_SETTINGS.items():
        spark.conf.set(name, value)


def tag_streams(requests: DataFrame, truths: DataFrame) -> DataFrame:
    """Both decoded streams as one, with a side tag."""
    # the wall clock is taken for UTC, whatever the session's zone: no hour is skipped or repeated
    clock = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("ts")
    a = requests.select(
        "slab_id", "pass_number", clock, F.lit("A").alias("side"), "steel_grade",
        expr.feature_vector(F.col("features")).alias("x"), F.col("baseline_roll_force_kn").alias("baseline"),
    )
    b = truths.select(
        "slab_id", "pass_number", clock, F.lit("B").alias("side"),
        F.col("actual_roll_force_kn").alias("actual"), "wear_level",
    )
    return a.unionByName(b, allowMissingColumns=True).withColumn("at", F.unix_micros("ts"))


#: Keys are dealt into so many buckets, and a bucket's events are paired column by column. The number is part of the state.
BUCKETS = 256
_WAITING_TYPES = T.StructType([
    T.StructField("slab_id", T.StringType()), T.StructField("pass_number", T.IntegerType()), T.StructField("at", T.LongType()),
    T.StructField("side", T.StringType()), T.StructField("steel_grade", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in ("baseline", "actual", "wear_level")],
])
_WAITING = to_arrow_schema(_WAITING_TYPES)


class PairProcessor(StatefulProcessor):
    """The waiting events of a bucket of keys, one for each key. Its deadline belongs to the event: no timer purges a later one.

    A call to the state store costs more than pairing an event, so a bucket's waiting events are one value, read and written
    once a micro-batch, and a bucket has one timer, at its earliest deadline. Within a key, what waits comes first and then the
    new events by time and side; what becomes of each is found as in ``match``: an event closes a pair with the one before it
    iff it is an odd number of rows after the last that its predecessor could not meet.

    Events at or before the watermark are late: they touch no state and leave at once, with their time as it was.
    """

    def __init__(self, ttl: float = DEFAULT_TTL):
        self.ttl = int(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "rows binary, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[_WAITING.names] for pdf in rows], ignore_index=True)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        late = ((new["at"] <= watermark) & (watermark > 0)).to_numpy()
        if late.any():
            yield _lost(new[late], "late", np.full(int(late.sum()), watermark + 1000))  # Spark wants what is emitted after it
            new = new[~late]
            if not len(new):
                return
        stored, due = self._load()
        events = new if stored is None else pd.concat([stored, new], ignore_index=True)
        fresh = np.arange(len(events)) >= len(events) - len(new)
        number = events.groupby(["slab_id", "pass_number"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((events["side"].to_numpy(dtype="U1"), events["at"].to_numpy(), fresh, number))
        events, number = events.take(order), number[order]
        at, side, here = events["at"].to_numpy(dtype=np.int64), events["side"].to_numpy(dtype="U1"), np.arange(len(events))
        same, expired = np.zeros(len(events), dtype=bool), np.zeros(len(events), dtype=bool)
        same[1:], expired[1:] = number[1:] == number[:-1], at[:-1] + self.ttl <= at[1:]
        linked = same & ~expired
        linked[1:] &= side[1:] != side[:-1]
        closes = (here - np.maximum.accumulate(np.where(linked, 0, here))) % 2 == 1
        ends = np.flatnonzero(closes)
        if len(ends):
            yield _pairs(events, side, ends, at[ends])
        replaces = same & ~closes
        replaces[1:] &= ~closes[:-1]
        for status, chosen in (("orphan", replaces & expired), ("superseded", replaces & ~expired)):
            by = np.flatnonzero(chosen)
            if len(by):
                yield _lost(events.take(by - 1), status, at[by])
        last = np.append(number[1:] != number[:-1], True)
        self._store(events[last & ~closes], due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, _ = self._load()
        if waiting is None:
            return
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = (self._deadlines(waiting) <= passed).to_numpy()
        if over.any():
            yield _lost(waiting[over], "orphan", (waiting["at"][over] + self.ttl).to_numpy())
        self._store(waiting[~over], None)

    def close(self) -> None:
        pass

    def _deadlines(self, events: pd.DataFrame) -> pd.Series:
        """Deadlines in milliseconds, rounded up so that no timer fires early."""
        return -(-(events["at"] + self.ttl) // 1000)

    def _load(self):
        if not self.slot.exists():
            return None, None
        blob, due = self.slot.get()
        return unpacked(bytes(blob)).to_pandas(), due

    def _store(self, waiting: pd.DataFrame, due: int | None) -> None:
        """``due`` is the timer that is set now, None for one that has just fired."""
        first = int(self._deadlines(waiting).min()) if len(waiting) else None
        if due is not None and due != first:
            self.handle.deleteTimer(due)
        if first is not None and due != first:
            self.handle.registerTimer(first)
        if first is not None:
            self.slot.update((packed(waiting, _WAITING), first))
        elif self.slot.exists():
            self.slot.clear()


def _decided(at: np.ndarray) -> pd.Series:
    """``event_ts``, when a fate was decided: the event's own time may lie behind the watermark by then."""
    return pd.Series(np.asarray(at, dtype=np.int64).astype("datetime64[us]")).dt.tz_localize("UTC")


def _lost(events: pd.DataFrame, status: str, decided_at: np.ndarray) -> pd.DataFrame:
    out = events.reset_index(drop=True)
    of_a = out["side"] == "A"
    return out.assign(
        status=status, event_ts=_decided(decided_at), a_at=out["at"].where(of_a).astype("Int64"), b_at=out["at"].where(~of_a).astype("Int64")
    )[_PAIR_FIELDS]


def _pairs(events: pd.DataFrame, side: np.ndarray, ends: np.ndarray, decided_at: np.ndarray) -> pd.DataFrame:
    of_a = np.where(side[ends] == "A", ends, ends - 1)
    a, b = events.take(of_a).reset_index(drop=True), events.take(2 * ends - 1 - of_a).reset_index(drop=True)
    return a.assign(
        status="matched", event_ts=_decided(decided_at), a_at=a["at"], b_at=b["at"], actual=b["actual"], wear_level=b["wear_level"]
    )[_PAIR_FIELDS]


def pair_stream(tagged: DataFrame, ttl: float = DEFAULT_TTL, delay: str = "5 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Pairs, orphans, superseded and late events of a tagged stream (``status`` tells them apart).

    The watermark is taken from ``ts``, which the processor does not get: Spark drops late rows only where it sees the
    watermarked column, and here the processor passes them on. A restarted job keeps its number of ``buckets``.
    """
    return (
        tagged.withWatermark("ts", delay).drop("ts")
        .withColumn("bucket", F.pmod(F.xxhash64("slab_id", "pass_number"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .transformWithStateInPandas(
            PairProcessor(ttl), outputStructType=PAIR_SCHEMA, outputMode="Append", timeMode="EventTime",
            eventTimeColumnName="event_ts",
        )
    )


_COMPUTED = (
    "target_mean_roll_force_kn", "sgd_roll_force_kn", "am_rules_roll_force_kn", "baseline_ape", "target_mean_ape", "sgd_ape",
    "am_rules_ape", "am_rules_shadow_ape", "is_am_rules_fallback",
)
#: What is held of a matched row until its turn.
_HELD_TYPES = T.StructType([
    T.StructField("b_at", T.LongType()), T.StructField("a_at", T.LongType()), T.StructField("slab_id", T.StringType()),
    T.StructField("pass_number", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in ("baseline", "actual", "wear_level")],
])
_HELD = to_arrow_schema(_HELD_TYPES)


def packed(rows: pd.DataFrame | pa.RecordBatch, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, schema, preserve_index=False) if isinstance(rows, pd.DataFrame) else rows
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as reader:
        return reader.read_all()


class GradeProcessor(StatefulProcessor):
    """The model set of one key, trained in the order of measurement.

    Matched rows are held in ``held``, a chunk for each ``HELD_ROWS`` rows of a micro-batch and stretch of ``stretch`` seconds, and
    ``chunks`` knows how many a stretch has. A truth may come before its request, so a pair made at the watermark can have been measured up to ``ttl``
    earlier: a stretch is due when the watermark has passed its end by that. Its timer drains all stretches that are due, one
    after another, so that no more than one is in memory. The models are read and written once for each such call.
    """

    HELD_ROWS = 100_000

    def __init__(self, settings: Settings = Settings(), challenger: str = "rules", ttl: float = DEFAULT_TTL, stretch: float = 60.0):
        self.settings, self.challenger = settings, challenger
        self.ttl, self.stretch = int(ttl * 1_000_000), int(stretch * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.models = handle.getValueState("models", "blob binary")
        self.held = handle.getMapState("held", "stretch long, chunk int", "rows binary")
        self.chunks = handle.getMapState("chunks", "stretch long", "n int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for blob in initialState["blob"]:
            self.models.update((bytes(blob),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in rows:
            lost = pdf[pdf["status"] != "matched"]
            if len(lost):  # passed on as they are
                yield lost.rename(columns={
                    "status": "kind", "baseline": "baseline_roll_force_kn", "actual": "actual_roll_force_kn"}).reindex(columns=_RESULT_FIELDS)
            matched = pdf.loc[pdf["status"] == "matched", _HELD.names]
            held, size = [*held, matched], size + len(matched)
            if size >= self.HELD_ROWS:
                self._hold(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if size:
            self._hold(pd.concat(held, ignore_index=True))

    def _hold(self, rows: pd.DataFrame) -> None:
        """A chunk for each stretch: the rows are sorted by it once and cut."""
        number = (rows["b_at"].astype("int64") // self.stretch).to_numpy()
        order = np.argsort(number, kind="stable")
        batch, number = pa.RecordBatch.from_pandas(rows.take(order), _HELD, preserve_index=False), number[order]
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(number)]):
            stretch = int(number[lo])
            count = self.chunks.getValue((stretch,))
            if count is None:
                self.handle.registerTimer(self._due(stretch))
            chunk = 0 if count is None else count[0]
            self.held.updateValue((stretch, chunk), (packed(batch.slice(lo, hi - lo), _HELD),))
            self.chunks.updateValue((stretch,), (chunk + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(number for (number,) in self.chunks.keys() if self._due(number) <= passed)
        if not due:  # an earlier timer of this batch has drained it
            return
        model = KeyModels.load(bytes(self.models.get()[0])) if self.models.exists() else None
        for number in due:
            (count,) = self.chunks.getValue((number,))
            chunks = [unpacked(bytes(self.held.getValue((number, k))[0])) for k in range(count)]
            pdf = pa.concat_tables(chunks).to_pandas().sort_values(["b_at", "slab_id", "pass_number"], kind="stable")
            if model is None:
                model = KeyModels(len(pdf["x"].iloc[0]), self.settings, self.challenger)
            scored = model.steps(np.stack(pdf["x"].tolist()).astype(float), pdf["baseline"].to_numpy(float), pdf["actual"].to_numpy(float))
            for k in range(count):
                self.held.removeKey((number, k))
            self.chunks.removeKey((number,))
            out = pdf.assign(kind="matched", steel_grade=key[0], **dict(zip(_COMPUTED, scored)))
            yield out.rename(columns={"baseline": "baseline_roll_force_kn", "actual": "actual_roll_force_kn"})[_RESULT_FIELDS]
        self.models.update((model.dump(),))

    def close(self) -> None:
        pass

    def _due(self, number: int) -> int:
        """When a stretch is complete, in milliseconds of the watermark, rounded up."""
        return -(-((number + 1) * self.stretch + self.ttl) // 1000)


def wall_clock(micros: str) -> Column:
    """Microseconds back to a zone-less timestamp, without the session's zone."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({micros} AS DECIMAL(20, 0)) / 1000000)")


def evaluate_stream(pairs: DataFrame, settings: Settings = Settings(), challenger: str = "rules", ttl: float = DEFAULT_TTL,
                    stretch: float = 60.0, models: DataFrame | None = None) -> DataFrame:
    """Result rows of the matched pairs of a stream, one model set per grade; events without a partner pass through.

    ``kind`` is ``matched``, ``orphan``, ``superseded`` or ``late``; ``evaluation_timestamp`` the time of the truth, else of the
    request. ``models`` (steel_grade, blob) start the grades of a new query, see ``live_models``; a restarted one has its own.
    """
    scored = pairs.groupBy("steel_grade").transformWithStateInPandas(
        GradeProcessor(settings, challenger, ttl, stretch), outputStructType=RESULT_SCHEMA, outputMode="Append", timeMode="EventTime",
        initialState=None if models is None else models.groupBy("steel_grade"),
    )
    return scored.select("kind", wall_clock("coalesce(b_at, a_at)").alias("evaluation_timestamp"), *RESULT_COLUMNS[1:])


def serve(raw_requests: DataFrame, raw_truths: DataFrame, ttl: float = DEFAULT_TTL, delay: str = "5 minutes",
          settings: Settings = Settings(), challenger: str = "rules", stretch: float = 60.0, models: DataFrame | None = None) -> DataFrame:
    """The whole job: raw JSON of both topics in; result rows, events without a partner, late and unusable records out.

    ``kind`` tells them apart (``quarantine`` for the last, with ``body`` and ``reject_reason``), so that one sink writes
    all of a micro-batch or nothing of it.
    """
    tagged = tag_streams(decode_events(raw_requests, "request"), decode_events(raw_truths, "truth"))
    served = evaluate_stream(pair_stream(tagged, ttl, delay), settings, challenger, ttl, stretch, models)
    for raw, side in ((raw_requests, "request"), (raw_truths, "truth")):
        bad = quarantine_events(raw, side).select(F.lit("quarantine").alias("kind"), F.lit(side).alias("topic"), "body", "reject_reason")
        served = served.unionByName(bad, allowMissingColumns=True)
    return served


SERVED_SCHEMA = (
    "kind string, evaluation_timestamp timestamp_ntz, " + RESULT_SCHEMA.split("a_at long, ", 1)[1]
    + ", topic string, body string, reject_reason string"
)


def read_served(spark: SparkSession, path: str) -> DataFrame:
    """What ``serve`` has published so far through ``sinks.batch_writer``."""
    return read_live(spark, path, SERVED_SCHEMA)


def _state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    known = spark.read.format("state-metadata").load(checkpoint).where(F.col("operatorProperties").contains(f'"{variable}"'))
    options = {"stateVarName": variable, "operatorId": known.select("operatorId").first()[0]}
    return spark.read.format("statestore").options(**options).load(checkpoint)


def waiting_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The events that wait in the state of a stopped job for their partner: ``key`` (slab_id, pass_number) and ``value``."""
    rows = _state_of(spark, checkpoint, "slot").select(F.col("value.rows").alias("rows"))

    def open_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("rows").to_pylist():
                yield from unpacked(blob).to_batches()

    found = rows.mapInArrow(open_buckets, _WAITING_TYPES)
    return found.select(F.struct("slab_id", "pass_number").alias("key"), F.struct(*_WAITING.names[2:]).alias("value"))


def held_rows_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The matched rows that a stopped job still holds, as they are held."""
    schema = T.StructType([T.StructField("steel_grade", T.StringType()), *_HELD_TYPES.fields])

    def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grade, blob in zip(batch.column("steel_grade").to_pylist(), batch.column("rows").to_pylist()):
                for part in unpacked(blob).to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([grade] * len(part), pa.string()), *part.columns], names=["steel_grade", *_HELD.names])

    chunks = _state_of(spark, checkpoint, "held").select(F.col("key.steel_grade").alias("steel_grade"), F.col("user_map_value.rows").alias("rows"))
    return chunks.mapInArrow(open_chunks, schema)


def held_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The same, in the form that ``evaluation.prequential_rows`` takes."""
    rows = held_rows_of(spark, checkpoint)
    return rows.select(
        wall_clock("b_at").alias("evaluation_timestamp"), "steel_grade", "slab_id", "pass_number", "baseline", "actual", "wear_level",
        *[F.col("x")[i].alias(name) for i, name in enumerate(X)], expr.residual(F.col("actual"), F.col("baseline")).alias("residual"))


def live_models(state: dict[str, DataFrame], settings: Settings = Settings(), challenger: str = "rules") -> DataFrame:
    """Saved models (``evaluation.read_checkpoint``, keyed by grade) as a new live job takes them: (steel_grade, blob)."""
    tables = [state["offset"], state["moments"], state["weights"], state["rules" if challenger == "rules" else "trust"]]
    joined = tables[0]
    for table in tables[1:]:
        joined = joined.withColumnRenamed("steel_grade", "_g").join(table, F.col("_g").eqNullSafe(table["steel_grade"])).drop("_g")

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            blobs = []
            for row in pdf.to_dict("records"):
                model = KeyModels(len(row["_mean0"]), settings, challenger)
                model.offset = row["_c__tm"]
                model.n, model.mean, model.m2 = int(row["_n0"]), np.array(row["_mean0"], float), np.array(row["_m20"], float)
                model.weights, model.bias = np.array(row["_v"][:-1], float), float(row["_v"][-1])
                if challenger == "rules":
                    rules = RulesAndRouter(list(X), settings)
                    rules.load(bytes(row["_state"]))
                    model.rules, model.router = rules.rules, rules.router
                else:
                    model.router = Router(settings, row["_c__mt"], row["_c__bt"])
                blobs.append(model.dump())
            yield pd.DataFrame({"steel_grade": pdf["steel_grade"], "blob": blobs})

    return joined.mapInPandas(build, "steel_grade string, blob binary")


def saved_models(spark: SparkSession, checkpoint: str, challenger: str = "rules") -> dict[str, DataFrame]:
    """The models of a stopped live job as batch runs take them and ``evaluation.write_checkpoint`` saves them."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for grade, blob in zip(pdf["steel_grade"], pdf["blob"]):
                model = KeyModels.load(bytes(blob))
                rules = RulesAndRouter(list(X), model.settings)
                rules.rules, rules.router = model.rules, model.router
                rows.append((grade, model.offset, model.n, model.mean.tolist(), model.m2.tolist(), [*model.weights.tolist(), model.bias],
                             model.router.model_trust, model.router.baseline_trust, rules.dump()))
            yield pd.DataFrame(rows, columns=["steel_grade", "_c__tm", "_n0", "_mean0", "_m20", "_v", "_c__mt", "_c__bt", "_state"])

    blobs = _state_of(spark, checkpoint, "models").select(F.col("key.steel_grade").alias("steel_grade"), F.col("value.blob").alias("blob"))
    every = materialize(blobs.mapInPandas(
        read, "steel_grade string, _c__tm double, _n0 long, _mean0 array<double>, _m20 array<double>, _v array<double>, "
              "_c__mt double, _c__bt double, _state binary"), "live-models")
    tables = {"offset": ["_c__tm"], "moments": ["_n0", "_mean0", "_m20"], "weights": ["_v"]}
    tables |= {"rules": ["_state"]} if challenger == "rules" else {"trust": ["_c__mt", "_c__bt"]}
    return {name: every.select("steel_grade", *columns) for name, columns in tables.items()}


class LateRows(StreamingQueryListener):
    """Total of the rows that Spark dropped behind the watermark, batch after batch: ``spark.streams.addListener`` before the start.

    The job itself drops none: late events are rows of kind ``late``. This is the proof. The progress that a query keeps
    ends at its last hundred batches; events reach a listener for all of them.
    """

    def __init__(self):
        self.total = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
