"""Both window kinds of a stream from a log of panes.

A micro-batch is counted: one row for each sensor, pane and value, which merge by adding. The counts are the state: no event is
copied to its windows, only the windows of panes that a batch touches are made again, and a window is what its panes' counts say.
The log has, below one folder and by batch number, so that a replayed batch writes the same again:

  rows/    the counts of a batch; `late`: a window with the row had ended before the watermark when it came
  base/    every some batches: the counts of panes of open windows, merged; rows and bases before the last base but one are removed
  archive/ at the same time, once: the counts of panes that no open window has, by day
  late/    at the same time, once: which panes got late rows, by day
  windows/ windows whose values a batch has changed, before and after it, and those that the watermark has passed with it, `closed`;
           most are both, and each is made once
  clock/   written last: the batch is done; watermark and counts

The watermark is the latest event time so far less the allowed lateness. What a batch reads and writes depends on it, on the open
panes and on the batches since the last base, not on the stream's age.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.functions import rounded_mean, scale_of
from sensorloom.session import exists, fresh_path, parts_for, remove

KEY = ("window_type", "window_start_ms", "sensor_id")
STATS = ("cnt", "sum_value", "min_value", "max_value", "avg_value")
RANKS = ("p50", "p99")
NEVER = -(1 << 62)
#: Windows of a sensor that are made where their panes' counts are; the first panes of a block go to the one before too.
SPAN = 60


@dataclass(frozen=True)
class PaneLog:
    """Where the log is, the pane's length, panes of a sliding window, allowed lateness, and how often counts are merged."""

    folder: str
    pane_ms: int = 60_000
    panes: int = 5
    lateness_ms: int = 900_000
    merge_every: int = 20

    def path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def ends(self, window_type: Column, start: Column) -> Column:
        """When a window that starts with this pane ends."""
        return (start + F.when(window_type == "sliding", self.panes).otherwise(1)) * self.pane_ms

    def is_open(self, pane: Column, watermark: int) -> Column:
        """Whether some window with this pane hasn't ended."""
        return (pane + self.panes) * self.pane_ms > watermark

    def last_base(self, before: int) -> int:
        """The base that batch `before` starts from, -1 if there is none yet."""
        return before // self.merge_every * self.merge_every - 1


def counted(events: DataFrame, log: PaneLog) -> DataFrame:
    pane = F.floor(F.unix_millis("ts") / log.pane_ms)
    return events.groupBy("sensor_id", pane.alias("pane"), "value").agg(F.count("*").alias("c"), F.max(F.unix_millis("ts")).alias("high"))


def _read(spark: SparkSession, log: PaneLog, upto: int) -> DataFrame | None:
    """The counts of open panes after this batch: the last base and the batches since; None before the first."""
    if upto < 0:
        return None
    base = log.last_base(upto)
    paths = ([log.path("base", base)] if base >= 0 else []) + [log.path("rows", i) for i in range(base + 1, upto + 1)]
    return spark.read.parquet(*paths).select("sensor_id", "pane", "value", "c")


def _starts(rows: DataFrame, log: PaneLog) -> DataFrame:
    """Each row once for each window with its pane: window_type and start, a pane's number."""
    kinds = F.array(F.struct(F.lit("tumbling").alias("window_type"), F.lit(0).alias("k")), *[F.struct(F.lit("sliding").alias("window_type"), F.lit(k).alias("k")) for k in range(log.panes)])
    return rows.withColumn("w", F.explode(kinds)).withColumns({"window_type": F.col("w.window_type"), "start": F.col("pane") - F.col("w.k")}).drop("w")


def _parts(log: PaneLog, rows: DataFrame) -> int:
    """Partitions for the windows of these counts, read from files: each count is in one tumbling and some sliding windows."""
    return parts_for(rows.sparkSession, (log.panes + 1) * rows.count())


def windows_of(rows: DataFrame, log: PaneLog, parts: int, counts: tuple[str, ...] = ("c",), hit: Column | None = None, after: int = NEVER, upto: int = -NEVER) -> DataFrame:
    """window_type, start, sensor_id, for each of the count columns a struct of the values, null where it counts nothing, and hit.

    rows: sensor_id, pane, value and the counts, in any number of rows; those with a null value count nothing. hit: whether the window
    has a row for which this holds. Only windows that end after `after` and not after `upto`. Counts move once, to blocks of windows of
    their sensor, and each window's ranks come from running counts over its sorted values, of which no list is made.
    """
    scale, n = scale_of(rows, "value"), log.panes - 1
    block = lambda x: F.floor(x / SPAN)
    blocks = F.explode(F.sequence(block(F.col("pane") - n), block(F.col("pane")))).alias("block")
    moved = rows.select("sensor_id", "pane", "value", *counts, (F.lit(True) if hit is None else hit).alias("hit"), blocks).repartition(parts, "sensor_id", "block")
    merged = moved.groupBy("sensor_id", "block", "pane", "value").agg(*[F.sum(c).alias(c) for c in counts], F.max("hit").alias("hit"))
    dealt = merged.withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(n)))).withColumns({"is_tumbling": F.col("k") < 0, "start": F.col("pane") - F.greatest(F.col("k"), F.lit(0))})
    ends = log.ends(F.when(F.col("is_tumbling"), "tumbling").otherwise("sliding"), F.col("start"))
    dealt = dealt.where((block(F.col("start")) == F.col("block")) & (ends > after) & (ends <= upto)).drop("k", "pane")
    by = ["start", "sensor_id", "block", "is_tumbling"]
    sorted_ = W.partitionBy(*by).orderBy("value")
    running, whole = sorted_.rowsBetween(W.unboundedPreceding, 0), sorted_.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summed = dealt.select("*", *[F.sum(c).over(w).alias(f"{c}_{name}") for c in counts for name, w in (("upto", running), ("all", whole))])
    own = [F.max("hit").alias("hit")]
    for c in counts:
        here = F.when(F.col("is_tumbling") & (F.col(c) > 0), F.col("value"))
        total = F.sum(here * F.col(c))
        own += [F.sum(c).alias(f"{c}_n"), (total if scale is None else total.cast(f"decimal(28,{scale})")).alias(f"{c}_sum"), F.min(here).alias(f"{c}_lo"), F.max(here).alias(f"{c}_hi")]
        own += [F.min(F.when(~F.col("is_tumbling") & (F.col(f"{c}_upto") * 100 >= F.col(f"{c}_all") * int(p[1:])), F.col("value"))).alias(f"{c}_{p}") for p in RANKS]
    grouped = summed.groupBy(*by).agg(*own)
    out = []
    for c in counts:
        total = F.col(f"{c}_n")
        tumbling = dict(zip(STATS, (total, F.col(f"{c}_sum"), F.col(f"{c}_lo"), F.col(f"{c}_hi"), rounded_mean(F.col(f"{c}_sum"), total, scale))))
        fields = [F.col(f"{c}_{p}").alias(p) for p in RANKS] + [F.when(F.col("is_tumbling"), x).alias(p) for p, x in tumbling.items()]
        out.append(F.when(total > 0, F.struct(*fields)).alias(c))
    return grouped.select(F.when(F.col("is_tumbling"), "tumbling").otherwise("sliding").alias("window_type"), "start", "sensor_id", *out, "hit")


def _typed(rows: DataFrame, log: PaneLog, values: str = "c") -> DataFrame:
    """The columns of all_windows, without the flag."""
    return rows.select("window_type", (F.col("start") * log.pane_ms).alias("window_start_ms"), "sensor_id", f"{values}.*")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sensor_id", "pane", "value").agg(F.sum("c").alias("c"))


def _by_day(rows: DataFrame, start_ms: Column) -> DataFrame:
    return rows.withColumn("day", F.date_format(F.timestamp_millis(start_ms), "yyyy-MM-dd"))


def _made(spark: SparkSession, log: PaneLog, number: int, watermark: int, after: int) -> DataFrame:
    """Windows with their values before and after a batch: those that were open and that it changed, with a flag, and those that it closed."""
    new = spark.read.parquet(log.path("rows", number)).select("sensor_id", "pane", "value", "c")
    old = _read(spark, log, number - 1)
    each = new.withColumns({"before": F.lit(0).cast("long"), "after": F.col("c")})
    if old is not None:
        each = each.unionByName(old.withColumns({"before": F.col("c"), "after": F.col("c")}))
    parts = _parts(log, new if old is None else new.union(old))
    made = windows_of(each.where(log.is_open(F.col("pane"), watermark)), log, parts, ("before", "after"), F.col("before") < F.col("after"), after=watermark)
    changed = F.col("hit") & ~F.col("before").eqNullSafe(F.col("after"))
    flag = F.when(changed, F.when(F.col("before").isNull(), "new").otherwise("updated"))
    closed = log.ends(F.col("window_type"), F.col("start")) <= after
    return made.where(changed | closed).select("window_type", (F.col("start") * log.pane_ms).alias("window_start_ms"), "sensor_id", flag.alias("flag"), closed.alias("closed"), "before", "after")


def _clock(spark: SparkSession, log: PaneLog, number: int) -> dict:
    return spark.read.parquet(log.path("clock", number)).first().asDict() if number >= 0 else {"watermark": NEVER}


def _merge(spark: SparkSession, log: PaneLog, number: int, watermark: int) -> None:
    """The next base; panes that are done go to the archive. A replay of this batch still finds what it was made from."""
    base = log.last_base(number)
    whole, stays = _merged(_read(spark, log, number)), log.is_open(F.col("pane"), watermark)
    whole.where(stays).write.mode("overwrite").parquet(log.path("base", number))
    _by_day(whole.where(~stays), F.col("pane") * log.pane_ms).write.mode("overwrite").partitionBy("day").parquet(log.path("archive", number))
    rows = spark.read.parquet(*[log.path("rows", i) for i in range(base + 1, number + 1)])
    late = rows.where("late").select("sensor_id", "pane").distinct()
    _by_day(late, F.col("pane") * log.pane_ms).write.mode("overwrite").partitionBy("day").parquet(log.path("late", number))
    for i in range(base - log.merge_every + 1, base + 1):
        for kind in ("rows", "clock"):
            remove(spark, log.path(kind, i))
    if base - log.merge_every >= 0:
        remove(spark, log.path("base", base - log.merge_every))


def take(batch: DataFrame, number: int, log: PaneLog) -> None:
    """One micro-batch: everything is written under its number, the clock last."""
    spark, before = batch.sparkSession, _clock(batch.sparkSession, log, number - 1)
    watermark = before["watermark"]
    late = (F.col("pane") + 1) * log.pane_ms <= watermark
    counted(batch, log).withColumn("late", late).write.mode("overwrite").parquet(log.path("rows", number))
    seen = spark.read.parquet(log.path("rows", number)).agg(F.max("high").alias("high"), F.sum("c").alias("events"), F.sum(F.when(F.col("late"), F.col("c"))).alias("late")).first()
    after = watermark if seen["high"] is None else max(watermark, seen["high"] - log.lateness_ms)
    _made(spark, log, number, watermark, after).write.mode("overwrite").parquet(log.path("windows", number))
    if number % log.merge_every == log.merge_every - 1:
        _merge(spark, log, number, after)
    spark.createDataFrame([(number, after, seen["events"] or 0, seen["late"] or 0)], "number long, watermark long, events long, late long").coalesce(1).write.mode("overwrite").parquet(log.path("clock", number))


def stream_panes(events: DataFrame, log: PaneLog, checkpoint: str, **trigger):
    """Start the query that keeps the log. Values are decimals or doubles; doubles' sums depend on the order of addition."""
    return events.writeStream.foreachBatch(lambda batch, number: take(batch, number, log)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def last_batch(spark: SparkSession, log: PaneLog) -> dict:
    """The clock of the last batch that is done: number, watermark, events and how many of these were late."""
    return max(spark.read.parquet(f"{log.folder}/clock").collect(), key=lambda r: r["number"]).asDict()  # of at most two bases' batches


def state_rows(spark: SparkSession, log: PaneLog) -> DataFrame:
    """The counts of open panes: what the stream keeps."""
    now = last_batch(spark, log)
    return _merged(_read(spark, log, now["number"])).where(log.is_open(F.col("pane"), now["watermark"]))


def _of(spark: SparkSession, log: PaneLog, kind: str, upto: int, schema: str) -> DataFrame:
    """A kind's folders of batches that are done, by day; nothing if there are none."""
    found = spark.read.schema(f"{schema}, batch long, day string").parquet(f"{log.folder}/{kind}") if exists(spark, f"{log.folder}/{kind}") else spark.createDataFrame([], f"{schema}, batch long, day string")
    return found.where(F.col("batch") <= upto)


def closed_windows(spark: SparkSession, log: PaneLog) -> DataFrame:
    """The windows that the watermark has passed, as they were then."""
    now = last_batch(spark, log)
    values = windows_of(_read(spark, log, now["number"]), log, 1).schema["c"].dataType.simpleString()
    schema = f"window_type string, window_start_ms long, sensor_id string, closed boolean, after {values}"
    return _of(spark, log, "windows", now["number"], schema).where("closed").select(*KEY, "after.*")


def open_windows(spark: SparkSession, log: PaneLog) -> DataFrame:
    """The windows that the watermark hasn't passed, so far."""
    now = last_batch(spark, log)
    rows = _read(spark, log, now["number"])
    return _typed(windows_of(rows.where(log.is_open(F.col("pane"), now["watermark"])), log, _parts(log, rows), after=now["watermark"]), log)


def current_windows(spark: SparkSession, log: PaneLog) -> DataFrame:
    """All windows; rows that came after their window had closed are not in it."""
    return closed_windows(spark, log).unionByName(open_windows(spark, log))


def corrected_windows(spark: SparkSession, log: PaneLog) -> DataFrame:
    """All windows with all rows, late ones too: closed windows of panes with late rows are made again from the archive's counts.

    Only the days of such panes are read from the archive, and only their windows are replaced.
    """
    now = last_batch(spark, log)
    number, watermark, base = now["number"], now["watermark"], log.last_base(now["number"])
    counts = f"sensor_id string, pane long, value {_read(spark, log, number).schema['value'].dataType.simpleString()}, c long"
    since = spark.read.parquet(*[log.path("rows", i) for i in range(base + 1, number + 1)]).where("late")
    late = _of(spark, log, "late", base, "sensor_id string, pane long").select("sensor_id", "pane").union(since.select("sensor_id", "pane")).distinct()
    span = log.panes - 1
    days = late.select(F.explode(F.sequence(F.col("pane") - span, F.col("pane") + span)).alias("pane"))
    days = [r[0] for r in _by_day(days, F.col("pane") * log.pane_ms).select("day").distinct().collect()]  # a name for each day with late rows
    every = _read(spark, log, number).unionByName(_of(spark, log, "archive", base, counts).where(F.col("day").isin(days)).select("sensor_id", "pane", "value", "c"))
    marks = late.withColumns({"value": F.lit(None).cast(every.schema["value"].dataType), "c": F.lit(0).cast("long")})  # they tell which windows have late rows
    made = windows_of(every.unionByName(marks), log, _parts(log, every), hit=F.col("value").isNull(), upto=watermark).where("hit")
    again = _starts(late, log).where(log.ends(F.col("window_type"), F.col("start")) <= watermark)
    gone = again.select("window_type", (F.col("start") * log.pane_ms).alias("window_start_ms"), "sensor_id").distinct()
    closed = closed_windows(spark, log)
    in_days = F.date_format(F.timestamp_millis("window_start_ms"), "yyyy-MM-dd").isin(days)
    kept = closed.where(~in_days).unionByName(closed.where(in_days).join(gone, list(KEY), "left_anti"))
    return kept.unionByName(_typed(made, log)).unionByName(open_windows(spark, log))


def changelog(spark: SparkSession, log: PaneLog) -> DataFrame:
    """Every change of a window's values: batch, key, flag (new or updated), before (null if new) and after.

    A batch that changes no value leaves nothing, and a replayed one the same as before. Rows that came too late change
    nothing here; see corrected_windows.
    """
    return spark.read.parquet(f"{log.folder}/windows").where((F.col("batch") <= last_batch(spark, log)["number"]) & F.col("flag").isNotNull()).drop("closed")


def run_panes(parts: list[DataFrame], lateness_ms: int = 900_000, merge_every: int = 2, pane_ms: int = 60_000, panes: int = 5) -> PaneLog:
    """The log after a stream has read the parts one after another, each in a run of its own from one checkpoint."""
    spark = parts[0].sparkSession
    source, folder, offsets = (fresh_path(spark, n) for n in ("pane-source", "pane-log", "pane-offsets"))
    log = PaneLog(folder, pane_ms, panes, lateness_ms, merge_every)
    for part in parts:
        part.write.mode("append").parquet(source)
        stream_panes(spark.readStream.schema(part.schema).parquet(source), log, offsets).awaitTermination()
    return log
