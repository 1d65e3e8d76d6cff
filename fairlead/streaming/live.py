"""The live pipeline on Structured Streaming: the batch folds as state of a stream, the rest per micro-batch.

The tracker and the detector keep one state per vessel in the state store and use the very functions of the batch
side, so a stream that is read to its end gives what the batch gives on the same input. Rows of a vessel within a
micro-batch are put into order before they are folded. State is dropped by event-time timers: tracks after half an
hour without reports, detector state after three hours.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.operators import anomalies, feed, places, risk, tracker
from fairlead.operators.fixes import is_sar_aircraft
from fairlead.operators.folds import names_of
from fairlead.sources import recorder

FIX_SCHEMA = "seq long, mmsi long, t double, lat double, lon double, sog double, cog double, pos_sigma_m double"


def read_fixes(spark, directory: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of fixes from a folder that Parquet files land in, with the event time as a timestamp."""
    rows = spark.readStream.schema(FIX_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    return rows.withColumn("ts", F.timestamp_seconds("t"))


STATE = T.StructType([T.StructField("state", T.BinaryType())])


def _keep(state: GroupState, held: object, until: float) -> None:
    """Until an event time, or the next watermark if that is past."""
    state.update((pickle.dumps(held),))
    state.setTimeoutTimestamp(int(max(until, state.getCurrentWatermarkMs() / 1000.0 + 1.0) * 1000))


def track(fixes: DataFrame, params: tracker.Params = tracker.Params(), late: str = "60 seconds") -> DataFrame:
    """The tracker's row for every fix of a stream with an event time `ts`."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else tracker.Track(params)
        rows, out = pd.concat(list(parts)).sort_values(["t", "seq"], kind="stable"), []
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            out += tracker.step(held, row)
        _keep(state, held, float(rows["t"].max()) + params.stale_s + params.sweep_s)
        yield pd.DataFrame(out, columns=names_of(tracker.SCHEMA))

    rows = tracker.with_sigma(fixes).withWatermark("ts", late)
    return rows.groupBy("mmsi").applyInPandasWithState(run, tracker.SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def watch(fixes: DataFrame, params: anomalies.Params = anomalies.Params(), late: str = "60 seconds") -> DataFrame:
    """What the detector's recursion finds, for every fix of a stream but aircraft's; silences are judged afterwards,
    per batch, and impossible speeds are a filter (`anomalies.impossible_speeds` takes a stream as it is)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else places.Sightings(params)
        rows = pd.concat(list(parts)).sort_values(["t", "seq"], kind="stable")
        out = held.feed(int(key[0]), *(rows[c].to_numpy(float) for c in ("t", "lat", "lon", "sog")))
        _keep(state, held, float(rows["t"].max()) + params.forget_s + params.sweep_s)
        yield pd.DataFrame(out, columns=names_of(places.SCHEMA))

    own = fixes.filter(~is_sar_aircraft(F.col("mmsi"))).withWatermark("ts", late)
    return own.groupBy("mmsi").applyInPandasWithState(run, places.SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def minute_histogram(fixes: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Reports per minute as a windowed aggregation."""
    counts = fixes.withWatermark("ts", late).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("n"))
    return counts.select((F.unix_timestamp("window.start") / 60).cast("long").alias("minute"), "n")


class Live:
    """A foreachBatch function over the rows of `track`: risk minute by minute, new encounters, and the feed's updates.

    What a batch leaves for the next (tracks not yet used for a minute, pairs at risk lately, the tracks as sent, and how
    far minutes are assessed) is a few small tables under the number of the batch. A batch reads those of the number
    before and overwrites its own and its results, so a batch that is done again, after a failure, gives the same.

    A minute is assessed once the stream has passed it by `late_s`, from the reports strictly before it, whichever
    batches they came in; minutes are rows, so a jump ahead in time costs nothing. `close` assesses the rest.

    risks/batch=N         Parquet: the pairs at risk in each minute
    encounters/batch=N    JSON lines: the first assessment of each encounter that is new
    feed/batch=N          text: one update message, where anything changed
    """

    SHORT = "minute double, mmsi_a long, mmsi_b long"
    TRACKS = "mmsi long, t double, seq long, lat double, lon double, v_east double, v_north double"

    FLAGS = "kind string, mmsi long, t double, lat double, lon double, value double"

    def __init__(
        self, directory: str, params: risk.Params = risk.Params(), late_s: float = 60.0, stale_s: float = tracker.Params().stale_s,
        flags: Callable[[DataFrame, int], DataFrame] | None = None,
    ) -> None:
        """`flags` gives the anomalies (FLAGS) to send with a batch, from its rows and number."""
        self.directory, self.params, self.late_s, self.stale_s, self.flags = directory, params, late_s, stale_s, flags

    def _read(self, spark: SparkSession, name: str, number: int, schema: str) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.directory}/state/{number}/{name}")

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.directory}/state/{number}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def __call__(self, batch: DataFrame, number: int) -> None:
        accepted = batch.filter("outcome IN ('started', 'updated', 'restarted')").select("mmsi", "t", "seq", "lat", "lon", "v_east", "v_north")
        flags = self.flags(batch, number) if self.flags else batch.sparkSession.createDataFrame([], self.FLAGS)
        self._advance(batch.sparkSession, accepted, number, self.late_s, flags)

    def close(self, spark: SparkSession, last: int) -> None:
        """Assesses the minutes that the stream has passed but that were kept open for late reports; `last` is the number
        of the last batch."""
        self._advance(spark, spark.createDataFrame([], self.TRACKS), last + 1, 0.0, spark.createDataFrame([], self.FLAGS))

    def _advance(self, spark: SparkSession, accepted: DataFrame, number: int, late_s: float, flags: DataFrame) -> None:
        clock = self._read(spark, "clock", number - 1, "passed double, done double").first()
        pool = self._write(self._read(spark, "open", number - 1, self.TRACKS).unionByName(accepted), "pool", number)
        newest = pool.agg(F.max("t")).first()[0]
        passed = max((x for x in (newest, clock and clock.passed) if x is not None), default=float("-inf"))
        done = clock.done if clock else float("-inf")
        upto = max(done, (passed - late_s) // 60 * 60) if passed > float("-inf") else done
        motions = risk.tracked(pool, self.params.fresh_s).filter((F.col("minute") > done) & (F.col("minute") <= upto))
        risks = risk.at_risk(motions, self.params)
        risks.write.mode("overwrite").parquet(f"{self.directory}/risks/batch={number}")
        risks = spark.read.schema(risks.schema).parquet(f"{self.directory}/risks/batch={number}")
        self._encounters(risks, number, upto)
        self._send(accepted, number, passed, flags)
        self._write(pool.filter(risk.minute_served(F.col("t")) > upto), "open", number)
        self._write(spark.createDataFrame([(passed, upto)], "passed double, done double"), "clock", number)

    def _encounters(self, risks: DataFrame, number: int, upto: float) -> None:
        lately = self._read(risks.sparkSession, "lately", number - 1, self.SHORT)
        ongoing = F.col("last") >= F.col("minute") - self.params.session_s
        first = risk.encounters(risks, self.params)
        before = lately.select("mmsi_a", "mmsi_b", F.col("minute").alias("last"))
        met = first.join(before, ["mmsi_a", "mmsi_b"], "left")
        new = met.filter(~F.coalesce(ongoing, F.lit(False))).select(F.col("minute").alias("t"), "mmsi_a", "mmsi_b", "type", "role_a", "role_b", "range_m", "tcpa_s", "dcpa_m")
        recorder.write_json_lines(new, f"{self.directory}/encounters/batch={number}", "overwrite")
        ends = lately.unionByName(risks.select("minute", "mmsi_a", "mmsi_b")).groupBy("mmsi_a", "mmsi_b").agg(F.max("minute").alias("minute"))
        self._write(ends.filter(F.col("minute") >= upto - self.params.session_s).select("minute", "mmsi_a", "mmsi_b"), "lately", number)

    def _send(self, accepted: DataFrame, number: int, passed: float, flags: DataFrame) -> None:
        spark = accepted.sparkSession
        sent = self._read(spark, "sent", number - 1, self.TRACKS)
        last = F.max_by(F.struct("t", "seq", "lat", "lon", "v_east", "v_north"), F.struct("t", "seq")).alias("p")
        now = sent.unionByName(accepted).groupBy("mmsi").agg(last).select("mmsi", "p.*").filter(F.col("t") >= passed - self.stale_s)
        now = self._write(now, "sent", number)
        changed = self._write(feed.changes(sent, now), "changes", number)
        if changed.isEmpty() and flags.isEmpty():
            return
        tracks = now.join(changed.filter("change = 'changed'"), "mmsi", "left_semi")
        risks = spark.read.parquet(f"{self.directory}/risks/batch={number}")
        current = risks.join(F.broadcast(risks.agg(F.max("minute").alias("minute"))), "minute", "left_semi")
        text = feed.message("update", passed, tracks, flags, current, changed.filter("change = 'removed'").select("mmsi"))
        text.select(F.col("json").alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.directory}/feed/batch={number}")


def run_to_end(stream: DataFrame, directory: str, checkpoint: str) -> None:
    """Reads what there is and stops; rows are appended as Parquet, exactly once."""
    query = stream.writeStream.format("parquet").option("path", directory).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
