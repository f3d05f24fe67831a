"""Changes of price and availability as a stream, right for rows in any order within the watermark: keyed state with timers of event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from martlens.functions.shared import drop_path, get_text, names_in, put_text
from martlens.streaming.buckets import BucketedState

#: What is observed of a listing: kind ``price`` or ``availability``, its value as text; o and n order rows of one time.
OBSERVED = "listing_id long, kind string, ts timestamp, o long, n long, value string"
CHANGES = "listing_id long, kind string, us long, previous string, current string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Transitions(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; then they are taken in order and compared with the last value.

    A value counts as the previous one for ``horizon`` seconds. A timer ends the state of a key that was idle for so long.
    """

    def __init__(self, horizon: float):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, value string")
        self.waiting = handle.getListState("waiting", "us long, o long, n long, value string")

    def handleInputRows(self, key: Row, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [Row(us=r.us, o=r.o, n=r.n, value=r.value) for r in rows]
        self.waiting.appendList(fresh)
        # Later rows are looked at when this timer fires, or by the one that is set then.
        self.handle.registerTimer(max(min(r.us for r in fresh) // 1000, 1))
        return iter(())

    def handleExpiredTimer(self, key: Row, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((us, o, n, v) for us, o, n, v in self.waiting.get())
        due = [r for r in rows if r[0] <= passed]
        last = self.last.get()
        moved = []
        for us, _, _, value in due:
            if last is not None and us < last[0]:
                continue  # from behind the watermark
            if last is not None and us - last[0] <= self.horizon * 1e6 and last[1] != value:
                moved.append((us, last[1], value))
            last = (us, value)
        later = [Row(us=us, o=o, n=n, value=v) for us, o, n, v in rows[len(due) :]]
        if due:
            self.last.update(last)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(max(later[0].us // 1000, passed // 1000 + 1))
        elif last is not None:
            end = int(last[0] + self.horizon * 1e6) // 1000 + 1
            if end * 1000 <= passed:
                self.last.clear()
            else:
                self.handle.registerTimer(end)
        for us, previous, current in moved:
            yield Row(listing_id=key.listing_id, kind=key.kind, us=us, previous=previous, current=current)

    def close(self) -> None:
        pass


def stream_changes(rows: DataFrame, late: str = "1 day", horizon_days: float = 3650) -> DataFrame:
    """listing_id, kind, ts, previous, current of the stream ``rows`` (OBSERVED): each value that differs from the one before it in order of ts, o, n, at most ``horizon_days`` older.

    Rows may come in any order and any batch while they are less than ``late`` behind the newest; later ones are dropped. A change is emitted when the watermark has
    passed it. Of a key that is quiet for ``horizon_days`` nothing is kept. The state is in RocksDB, which the session is set to.
    """
    rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    known = rows.filter("value IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    found = known.groupBy("listing_id", "kind").transformWithState(statefulProcessor=Transitions(horizon_days * 86400), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    return found.select("listing_id", "kind", F.timestamp_micros("us").alias("ts"), "previous", "current")


def _run(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _changes_below(spark: SparkSession, path: str, state: BucketedState, schema: str) -> DataFrame:
    """Changes of the batches whose markers are written."""
    done = max(state.done(spark), default=-1)
    found = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/changes") if done >= 0 else spark.createDataFrame([], f"{schema}, batch long")
    return found.filter(F.col("batch") <= done).drop("batch")


def bucketed_transitions(rows: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """listing_id, ts, previous, current of the stream of observations (listing_id, ts, o, n, availability): the last value of each listing is its state.

    A batch is expected to be later than those before it; its rows and the state's meet in one window by listing. Changes are written by batch below ``path``.
    """
    schema = "listing_id long, ts timestamp, previous string, current string"
    state = BucketedState(path, ("listing_id",), "listing_id long, last string", checkpoint, buckets)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.filter("listing_id IS NOT NULL").persist()
        order = Window.partitionBy("listing_id").orderBy("known", "ts", "o", "n")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            last = new.groupBy("listing_id").agg(F.max_by("availability", F.struct("ts", "o", "n")).alias("now"), F.lit(True).alias("new"))
            return old.join(last, "listing_id", "full").select("listing_id", F.when(F.col("new"), F.col("now")).otherwise(F.col("last")).alias("last"))

        def changes(old: DataFrame) -> None:
            seen = old.select("listing_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("o"), F.lit(None).cast("long").alias("n"), F.col("last").alias("availability"), F.lit(0).alias("known"))
            fresh = batch.select("listing_id", "ts", F.col("o").cast("long").alias("o"), F.col("n").cast("long").alias("n"), "availability", F.lit(1).alias("known"))
            moved = seen.unionByName(fresh).withColumn("previous", F.lag("availability").over(order)).filter("known = 1 AND previous <> availability")
            moved.select("listing_id", "ts", "previous", F.col("availability").alias("current")).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

        state.apply(batch, number, merge, changes)
        batch.unpersist()

    _run(rows, write, checkpoint)
    return _changes_below(rows.sparkSession, path, state, schema)


def bucketed_changes(rows: DataFrame, path: str, checkpoint: str, late_days: float = 1, horizon_days: float = 3650, buckets: int = 64) -> DataFrame:
    """What ``stream_changes`` finds, by windows over a batch and the state instead of key by key: listing_id, kind, ts, previous, current.

    The state holds the last settled row of each key and the rows that the watermark (the newest time less ``late_days``) has not passed. Each batch settles
    what it has passed; rows that come from behind the watermark of the batch before are dropped, keys that are quiet for ``horizon_days`` are forgotten.
    """
    held = ["listing_id", "kind", "us", "o", "n", "value"]
    late, horizon = int(late_days * 86_400_000_000), int(horizon_days * 86_400_000_000)
    state = BucketedState(path, ("listing_id", "kind"), "listing_id long, kind string, us long, o long, n long, value string, settled boolean", checkpoint, buckets)
    marks = f"{path}/watermarks"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = max(state.done(spark), default=None)
        passed = int(get_text(spark, f"{marks}/{before}")) if before is not None else None
        fresh = batch.filter("listing_id IS NOT NULL AND kind IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).select(*held)
        fresh = (fresh if passed is None else fresh.filter(F.col("us") > passed)).persist()
        newest = fresh.agg(F.max("us")).first()[0]
        mark = max((x for x in (passed, None if newest is None else newest - late) if x is not None), default=-(2**62))
        key = Window.partitionBy("listing_id", "kind")
        order = key.orderBy(F.col("settled").desc(), "us", "o", "n")

        def looked(old: DataFrame) -> DataFrame:
            """Settled and waiting rows in order, each with the row before it."""
            both = old.unionByName(fresh.withColumn("settled", F.lit(False))).withColumn("due", F.col("settled") | (F.col("us") <= mark))
            return both.withColumn("was", F.lag(F.struct("us", "value")).over(order)).withColumn("next_due", F.coalesce(F.lead("due").over(order), F.lit(False)))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            last = F.col("due") & ~F.col("next_due") & (F.col("us") + horizon > mark)
            return looked(old).filter(last | ~F.col("due")).select(*held, F.col("due").alias("settled"))

        def changes(old: DataFrame) -> None:
            moved = looked(old).filter(F.col("due") & ~F.col("settled") & (F.col("was.value") != F.col("value")) & (F.col("us") - F.col("was.us") <= horizon))
            moved.select("listing_id", "kind", F.timestamp_micros("us").alias("ts"), F.col("was.value").alias("previous"), F.col("value").alias("current")).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
            put_text(spark, f"{marks}/{number}", str(mark))

        if state.apply(fresh, number, merge, changes, every=True):
            for name in names_in(spark, marks):
                if name.isdigit() and before is not None and int(name) < before:
                    drop_path(spark, f"{marks}/{name}")
        fresh.unpersist()

    _run(rows, write, checkpoint)
    return _changes_below(rows.sparkSession, path, state, "listing_id long, kind string, ts timestamp, previous string, current string")
