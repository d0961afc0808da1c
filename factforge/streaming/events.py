"""Stateful jobs over status events as streams, each with a batch twin that gives the same result on the same events."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rank of a status: it only rises; the last two are terminal. Fixed values.
RANK = {"queued": 1, "generating_3d": 2, "generating_2d": 3, "completed": 4, "failed": 4}
TERMINAL = 4


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of parquet files of events as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


#: The one state store that holds the state of processors.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def finished(stream: DataFrame, shared: str, mode: str = "append", store: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns all that it wrote, from the shared folder. store: the state store of this stream
    alone; the session's own setting is put back."""
    spark = stream.sparkSession
    base = f"{shared}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    own = spark.conf.get(_STORE)
    if store:
        spark.conf.set(_STORE, store)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/{number:09d}")

    try:
        if mode == "append":
            q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        else:
            q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if store:
            spark.conf.set(_STORE, own)
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{base}/out")
    return spark.read.option("recursiveFileLookup", True).schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch int").parquet(f"{base}/out")


def fold(events: list[tuple[str, float]]) -> tuple[str, float, int, int]:
    """(status, progress, ignored, conflicts) of one job's events in order: rank only rises, an equal status needs more progress,
    a terminal status is final, another terminal one later is a conflict."""
    status, progress, ignored, conflicts = "", 0.0, 0, 0
    for new, value in events:
        rank, at = RANK[new], RANK.get(status, 0)
        if at == TERMINAL:
            conflicts += rank == TERMINAL and new != status
            ignored += not (rank == TERMINAL and new != status)
        elif rank > at or (new == status and value > progress):
            status, progress = new, value
        else:
            ignored += 1
    return status, progress, ignored, conflicts


class StatusFold(StatefulProcessor):
    """Keeps each job's fold in state and emits it after each batch of its events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "status string, progress double, ignored long, conflicts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        status, progress, ignored, conflicts = self.state.get() if self.state.exists() else ("", 0.0, 0, 0)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        before = [(status, progress)] if status else []
        status, progress, more, clash = fold([*before, *zip(events.status, events.value, strict=True)])
        ignored, conflicts = ignored + more, conflicts + clash
        self.state.update((status, float(progress), int(ignored), int(conflicts)))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [float(progress)], "ignored": [int(ignored)], "conflicts": [int(conflicts)]})

    def close(self) -> None:
        pass


FOLDED = "job_id long, status string, progress double, ignored long, conflicts long"


def status_fold(events: DataFrame) -> DataFrame:
    """Streaming fold of (job_id, ts, event_id, status, value). Such state lives in ROCKS, to be given to finished()."""
    return events.groupBy("job_id").transformWithStateInPandas(StatusFold(), FOLDED, "Update", "None")


def status_fold_batch(events: DataFrame) -> DataFrame:
    """The same fold over a table, in built-in functions: ordered events of a job, aggregated one after another."""
    rank = lambda s: F.coalesce(*(F.when(s == k, F.lit(v)) for k, v in RANK.items()), F.lit(0))
    ordered = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "status", "value"))).alias("all"))
    start = F.struct(F.lit("").alias("status"), F.lit(0.0).alias("progress"), F.lit(0).cast("long").alias("ignored"), F.lit(0).cast("long").alias("conflicts"))

    def step(s, e):
        done, last = rank(s["status"]) == TERMINAL, rank(e["status"]) == TERMINAL
        clash = done & last & (s["status"] != e["status"])
        takes = ~done & ((rank(e["status"]) > rank(s["status"])) | ((e["status"] == s["status"]) & (e["value"] > s["progress"])))
        return F.struct(F.when(takes, e["status"]).otherwise(s["status"]).alias("status"), F.when(takes, e["value"]).otherwise(s["progress"]).alias("progress"), (s["ignored"] + (~takes & ~clash).cast("long")).alias("ignored"), (s["conflicts"] + clash.cast("long")).alias("conflicts"))

    return ordered.select("job_id", F.aggregate("all", start, step).alias("f")).select("job_id", "f.*")


class ReplayGuard(StatefulProcessor):
    """Digest of each id seen, until the watermark has passed its event: the first is new, an equal one a replay, another one a conflict.

    An event older than the watermark is dropped before it comes here, so an id that is forgotten can't be met again. Ids of a bucket lie
    in cells: a batch asks the store once for each cell that it touches, not for each id, and writes back those with new ids."""

    def __init__(self, sweep_ms: int):
        self.sweep_ms = sweep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "cell int", "ids string")  # as JSON: id to digest and ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        events = pd.concat(list(rows)).sort_values(["cell", "ts", "digest"], kind="stable")
        ms = (events.ts.astype("datetime64[us]").astype("int64") // 1000).tolist()
        outcomes = []
        for cell, of_cell in groupby(zip(events.cell.tolist(), events.id, events.digest, ms, strict=True), key=lambda e: e[0]):
            found = self.seen.getValue((cell,))
            held = json.loads(found[0]) if found else {}
            before = len(held)
            for _, name, digest, at in of_cell:
                if name in held:
                    outcomes.append("replay" if held[name][0] == digest else "conflict")
                else:
                    held[name] = (digest, at)
                    outcomes.append("new")
            if len(held) > before:
                self.seen.updateValue((cell,), (json.dumps(held),))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(min(ms) + 1)
        yield pd.DataFrame({"id": events.id, "digest": events.digest, "ts": events.ts, "outcome": outcomes})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Sweeps a bucket, at most once in sweep_ms of event time."""
        now, oldest = timerValues.getCurrentWatermarkInMs(), None
        for cell in [k[0] for k in self.seen.keys()]:
            held = json.loads(self.seen.getValue((cell,))[0])
            left = {name: e for name, e in held.items() if e[1] >= now}
            if not left:
                self.seen.removeKey((cell,))
                continue
            if len(left) < len(held):
                self.seen.updateValue((cell,), (json.dumps(left),))
            oldest = min([e[1] for e in left.values()] + ([] if oldest is None else [oldest]))
        if oldest is not None:
            self.handle.registerTimer(max(oldest + 1, now + self.sweep_ms))
        return iter(())

    def close(self) -> None:
        pass


JUDGED = "id string, digest string, ts timestamp, outcome string"


def replays(events: DataFrame, key: list[str], content: list[str], ttl_seconds: int = 86_400, buckets: int = 64, cells: int = 16) -> DataFrame:
    """id, digest, ts, outcome of each arriving event: new, replay (the same content as the first of its id) or conflict. Events of one batch
    are taken by ts, then digest; one that is older than the newest by more than ttl_seconds is dropped, and ids as old are forgotten.
    Ids lie in buckets of state, so one busy owner is divided, and in so many cells of a bucket. Needs ROCKS; append mode."""
    ids = F.concat_ws(":", *(F.col(c).cast("string") for c in key))
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    rows = events.select(ids.alias("id"), digest.alias("digest"), "ts").withWatermark("ts", f"{ttl_seconds} seconds").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).withColumn("cell", F.pmod(F.hash("id"), F.lit(cells)))
    return rows.groupBy("bucket").transformWithStateInPandas(ReplayGuard(1000 * ttl_seconds // 4), JUDGED, "Append", "EventTime")


def replays_batch(events: DataFrame, key: list[str], content: list[str], order: list[str]) -> DataFrame:
    """The same of a table whose events came in an order."""
    ids = F.concat_ws(":", *(F.col(c).cast("string") for c in key))
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    rows = events.select(ids.alias("id"), digest.alias("digest"), "ts", *(F.col(c).alias(f"_{i}") for i, c in enumerate(order)))
    w = Window.partitionBy("id").orderBy(*(f"_{i}" for i in range(len(order))), "ts", "digest")
    outcome = F.when(F.row_number().over(w) == 1, "new").when(F.first("digest").over(w) == F.col("digest"), "replay").otherwise("conflict")
    return rows.select("id", "digest", "ts", outcome.alias("outcome"))


#: Statuses under which a worker holds a lease; any other one releases it.
LEASED = ("claimed", "generating_3d", "generating_2d", "uploading")


class LeaseTimer(StatefulProcessor):
    """A job's lease: armed anew by each heartbeat, released by a status without a lease, expired once when the watermark passes its end.

    Heartbeats wait in state until the watermark has passed them, so those that come out of order are taken in order; later ones than
    the watermark are dropped before. A job without a lease and without waiting events has no state."""

    def __init__(self, lease_us: int):
        self.lease_us = lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, leased boolean")
        self.lease = handle.getValueState("lease", "last_us long, heartbeats long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        events = pd.concat(list(rows))
        us = events.ts.astype("datetime64[us]").astype("int64")
        self.waiting.appendList([(int(u), int(e), bool(x)) for u, e, x in zip(us, events.event_id, events.leased, strict=True)])
        self.arm(int(us.min()) // 1000 + 1)
        return iter(())

    def arm(self, at_ms: int) -> None:
        """One timer, at the earlier of what is armed and this."""
        armed = [t for t in self.handle.listTimers()]
        if not armed or at_ms < min(armed):
            for t in armed:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        for t in self.handle.listTimers():
            if t != expiredTimerInfo.getExpiryTimeInMs():
                self.handle.deleteTimer(t)
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        last, beats = self.lease.get() if self.lease.exists() else (None, 0)
        ready, later = [e for e in events if e[0] // 1000 + 1 <= now], [e for e in events if e[0] // 1000 + 1 > now]
        out = []
        for us, _, leased in ready:
            if last is not None and us > last + self.lease_us:
                out.append((last + self.lease_us, beats))
                last, beats = None, 0
            last, beats = (us, beats + 1) if leased else (None, 0)
        if last is not None and (last + self.lease_us) // 1000 + 1 <= now:
            out.append((last + self.lease_us, beats))
            last = None
        self.waiting.put(later) if later else self.waiting.clear()
        self.lease.update((last, beats)) if last is not None else self.lease.clear()
        again = [later[0][0] // 1000 + 1] if later else []
        again += [(last + self.lease_us) // 1000 + 1] if last is not None else []
        if again:
            self.handle.registerTimer(min(again))
        if out:
            yield pd.DataFrame({"job_id": [key[0]] * len(out), "expired_us": [e for e, _ in out], "heartbeats": [n for _, n in out]})

    def close(self) -> None:
        pass


EXPIRED = "job_id long, expired_us long, heartbeats long"


def lease_expiries(events: DataFrame, lease_seconds: int, delay: str) -> DataFrame:
    """job_id, expired_us, heartbeats: a row for each lease that ran out, once, as soon as the watermark (the newest event less the delay)
    has passed its end. Events: job_id, ts, event_id, status. Needs ROCKS; append mode."""
    rows = events.select("job_id", "ts", "event_id", F.col("status").isin(*LEASED).alias("leased")).withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(LeaseTimer(1_000_000 * lease_seconds), EXPIRED, "Append", "EventTime")


def lease_expiries_batch(events: DataFrame, lease_seconds: int, delay_ms: int) -> DataFrame:
    """The same of a table, up to the watermark that its newest event leaves."""
    rows = events.select("job_id", "event_id", F.unix_micros("ts").alias("us"), F.col("status").isin(*LEASED).alias("leased"))
    end = rows.agg((F.floor(F.max("us") / 1000) - delay_ms).alias("now"))
    w = Window.partitionBy("job_id").orderBy("us", "event_id")
    lease = F.lit(1_000_000 * lease_seconds)
    breaks = ~F.lag("leased", 1, False).over(w) | (F.col("us") - F.lag("us").over(w) > lease)
    runs = rows.withColumn("run", F.sum(F.coalesce(breaks, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("us").over(w))
    beats = Window.partitionBy("job_id", "run").orderBy("us", "event_id")
    out = runs.where("leased").withColumn("heartbeats", F.row_number().over(beats).cast("long")).withColumn("expired_us", F.col("us") + lease).join(F.broadcast(end))  # one row
    out = out.where((F.col("next").isNull() | (F.col("next") > F.col("expired_us"))) & (F.floor(F.col("expired_us") / 1000) + 1 <= F.col("now")))
    return out.select("job_id", "expired_us", "heartbeats")


def latest_snapshot(events: DataFrame) -> DataFrame:
    """Newest status of each job, as a streaming aggregate in update mode or a table."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("n"))


def family_progress(events: DataFrame, family: F.Column) -> DataFrame:
    """Live progress of parents from their children's updates."""
    return events.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(F.max("value"), 6).alias("most"))


def last_rows(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key, of all batches."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in (key, "batch")]), "batch").alias("r")).select(key, "r.*")


def incremental(stream: DataFrame, folder: str, keep: Callable[[DataFrame], DataFrame], key: str, buckets: int = 64, tasks: int = 1) -> DataFrame:
    """What `keep` leaves of all rows of a stream, batch by batch: keep(rows) -> rows of the same columns, such that what it drops
    of a part never comes back with more rows (a best row, a sum). Kept rows lie in buckets of the key; a batch reads and writes
    only the buckets that it touches, and of these only what was kept, so work doesn't grow with all that has come. Where `tasks` are more
    than the session's shuffle partitions, a batch is dealt over so many by the key; each writes a file for each bucket that it has rows of.

    `folder` holds the buckets, the index of the batch that wrote each of them last, and the stream's own state: a stream that is
    started again with the same folder goes on where it stopped, and a batch that is run again reads what was there before it."""
    spark, schema = stream.sparkSession, stream.schema
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def newest(before: int) -> dict[int, int]:
        try:
            index = spark.read.schema("bucket int, batch int").parquet(f"{folder}/index/*")
            return dict(index.where(F.col("batch") < before).groupBy("bucket").agg(F.max("batch")).collect())  # at most `buckets` rows
        except AnalysisException:  # nothing is there yet
            return {}

    def held(batches: dict[int, int]) -> DataFrame:
        paths = [f"{folder}/kept/{n:09d}/bucket={b}" for b, n in sorted(batches.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def step(batch: DataFrame, number: int) -> None:
        touched = {r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()}  # at most `buckets` rows
        rows = held({b: n for b, n in newest(number).items() if b in touched}).unionByName(batch)
        kept = keep(rows.repartition(tasks, key) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows)
        kept.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/kept/{number:09d}")
        there = spark.read.parquet(f"{folder}/kept/{number:09d}").select("bucket").distinct().withColumn("batch", F.lit(number)) if touched else None
        if there is not None:
            there.coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/{number:09d}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return held(newest(2**31 - 1))
