"""Named queries over the `events` table, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import operators as O
from sensorloom.functions import exact_sums, sensor_name
from sensorloom.functions.ordering import magnitude_bits
from sensorloom.session import fresh_path, utc, written
from sensorloom.sources import ParseMetrics, as_events, generate_events, parse_lines, read_events, read_table, stream_events
from sensorloom.streaming import changelog, corrected_windows, current_windows, final_state, run_panes, run_to_end, stream_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: name suffix: key column, tumbling size, sliding size, slide, milliseconds of the slide
GRAINS = {
    "": ("user_id", "1 minute", "5 minutes", "1 minute", 60_000),
    "_hourly": ("event_type", "1 hour", "5 hours", "1 hour", 3_600_000),
    "_daily": ("event_type", "1 day", "5 days", "1 day", 86_400_000),
}
STATS = ("cnt", "sum_value", "min_value", "max_value", "avg_value")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the types that other engines share."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def events_sql(key: str, value: str = "value::DECIMAL(18,2)") -> str:
    sensor = "'sensor_' || lpad(user_id::VARCHAR, greatest(4, length(user_id::VARCHAR))::INTEGER, '0')" if key == "user_id" else key
    return f"e AS (SELECT event_id, ts, {sensor} AS sensor_id, {value} AS v FROM events WHERE ts IS NOT NULL AND {key} IS NOT NULL AND value IS NOT NULL)"


def tumbling_sql(ms: int, columns: str, key: str) -> str:
    return f"""WITH {events_sql(key)}, g AS (
  SELECT (epoch_us(ts) // 1000) // {ms} * {ms} AS window_start_ms, sensor_id, count(*) AS cnt, sum(v) AS s, min(v) AS lo, max(v) AS hi, CAST(sum(v) * 100 AS BIGINT) AS cents FROM e GROUP BY ALL)
SELECT {columns} FROM g"""


def sliding_sql(ms: int, columns: str, key: str) -> str:
    return f"""WITH {events_sql(key)}, g AS (
  SELECT (epoch_us(ts) // 1000) // {ms} * {ms} - k.k * {ms} AS window_start_ms, sensor_id, count(*) AS cnt, quantile_disc(v, 0.5) AS q50, quantile_disc(v, 0.99) AS q99 FROM e, range(5) k(k) GROUP BY ALL)
SELECT {columns} FROM g"""


AVG = "sign(cents) * ((abs(cents) + cnt // 2) // cnt) / 100.0"
STAT_SQL = {"cnt": "cnt", "sum_value": "s::DOUBLE", "min_value": "lo::DOUBLE", "max_value": "hi::DOUBLE", "avg_value": f"({AVG})::DOUBLE"}
TUMBLING_COLUMNS = "'tumbling' AS window_type, window_start_ms, sensor_id, " + ", ".join(f"{x} AS {c}" for c, x in STAT_SQL.items()) + ", 'new' AS flag"
SLIDING_COLUMNS = "'sliding' AS window_type, window_start_ms, sensor_id, q50::DOUBLE AS p50, q99::DOUBLE AS p99, cnt, 'new' AS flag"

for suffix, (key, size, wide, slide, ms) in GRAINS.items():
    T = lambda s, d, key=key, size=size: O.tumbling_stats(read_events(s, d, key), size)
    if suffix:  # few keys, each with a large share of all rows
        S = lambda s, d, key=key, slide=slide, ms=ms: O.sliding_counted(read_events(s, d, key), 5, slide, ms)
    else:
        S = lambda s, d, key=key, ms=ms: O.sliding_in_blocks(read_events(s, d, key), 5, ms)
    both = lambda s, d, key=key, ms=ms: O.both_in_blocks(read_events(s, d, key), 5, ms)
    sliding = sliding_sql(ms, SLIDING_COLUMNS, key)
    add(f"tumbling_stats{suffix}", T, tumbling_sql(ms, TUMBLING_COLUMNS, key))
    add(f"sliding_percentiles{suffix}", S, sliding)
    if not suffix:
        add("sliding_dealt", lambda s, d, key=key, wide=wide, slide=slide: O.sliding_percentiles(read_events(s, d, key), wide, slide), sliding)
    add(f"sliding_percentiles_disc{suffix}", lambda s, d, key=key, wide=wide, slide=slide: O.sliding_percentiles_disc(read_events(s, d, key), wide, slide), sliding)
    add(f"sliding_from_panes{suffix}", lambda s, d, key=key, slide=slide, ms=ms: O.sliding_from_panes(O.panes(read_events(s, d, key), slide), 5, ms), sliding)
    add(f"sliding_counted{suffix}", lambda s, d, key=key, slide=slide, ms=ms: O.sliding_counted(read_events(s, d, key), 5, slide, ms), sliding)
    for c in STATS:
        name = c.removesuffix("_value").replace("cnt", "count")
        add(f"tumbling_{name}{suffix}", lambda s, d, T=T, c=c: T(s, d).select("window_start_ms", "sensor_id", c), tumbling_sql(ms, f"window_start_ms, sensor_id, {STAT_SQL[c]} AS {c}", key))
    for c, q in (("p50", "q50::DOUBLE"), ("p99", "q99::DOUBLE"), ("cnt", "cnt")):
        add(f"sliding_{c.replace('cnt', 'count')}{suffix}", lambda s, d, S=S, c=c: S(s, d).select("window_start_ms", "sensor_id", c), sliding_sql(ms, f"window_start_ms, sensor_id, {q} AS {c}", key))
    add(
        f"all_windows_union{suffix}",
        (lambda s, d, T=T, S=S: O.all_windows(T(s, d), S(s, d))) if suffix else lambda s, d, both=both: O.union_of_both(both(s, d)),
        f"SELECT window_type, window_start_ms, sensor_id, p50, p99, flag, NULL::BIGINT AS cnt, NULL::DOUBLE AS sum_value, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS avg_value FROM ({sliding}) UNION ALL "
        f"SELECT window_type, window_start_ms, sensor_id, NULL, NULL, flag, cnt, sum_value, min_value, max_value, avg_value FROM ({tumbling_sql(ms, TUMBLING_COLUMNS, key)})",
    )
    add(
        f"rendered_lines{suffix}",
        (lambda s, d, T=T, S=S: O.to_lines(T(s, d), S(s, d))) if suffix else lambda s, d, both=both: O.lines_of_both(both(s, d)),
        sliding_sql(ms, "concat_ws(',', 'sliding', window_start_ms, sensor_id, q50::VARCHAR, q99::VARCHAR, 'new') AS line", key) + " UNION ALL SELECT * FROM (" + tumbling_sql(ms, f"concat_ws(',', 'tumbling', window_start_ms, sensor_id, cnt, s::DECIMAL(28,2)::VARCHAR, lo::VARCHAR, hi::VARCHAR, ({AVG})::DECIMAL(18,2)::VARCHAR, 'new') AS line", key) + ")",
    )
    add(
        f"rendered_from_panes{suffix}",
        lambda s, d, key=key, slide=slide, ms=ms: O.lines_of_both(O.both_from_panes(O.panes(read_events(s, d, key), slide), 5, ms)),
        ORACLE_SQL[f"rendered_lines{suffix}"],
    )


ALL_SQL = ORACLE_SQL["all_windows_union"]
add(
    "windows_in_order",
    lambda s, d: O.numbered(O.all_windows(QUERIES["tumbling_stats"](s, d), QUERIES["sliding_percentiles"](s, d))).select("position", "window_type", "window_start_ms", "sensor_id"),
    f"SELECT row_number() OVER (ORDER BY window_type, window_start_ms, sensor_id) AS position, window_type, window_start_ms, sensor_id FROM ({ALL_SQL})",
)


def with_hot_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, of which every third is of one sensor."""
    events = read_table(utc(spark), sf_dir, "events")
    return as_events(events.withColumn("sensor", F.when(F.col("event_id") % 3 == 0, "sensor_hot").otherwise(sensor_name(F.col("user_id")))), "sensor")


add("windows_by_heat", lambda s, d: O.windows_by_heat(with_hot_sensor(s, d)), ALL_SQL.replace("AS sensor_id, value::DECIMAL(18,2) AS v", "AS own_name, CASE WHEN event_id % 3 = 0 THEN 'sensor_hot' ELSE own_name END AS sensor_id, value::DECIMAL(18,2) AS v"))
add("both_in_blocks_hourly", lambda s, d: O.union_of_both(O.both_in_blocks(read_events(s, d, "event_type"), 5, 3_600_000, 24)), ORACLE_SQL["all_windows_union_hourly"])


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events 54 years earlier, so that some are before the epoch and some after it."""
    return read_events(spark, sf_dir).withColumn("ts", F.col("ts") - F.expr("INTERVAL 19736 DAYS 7 HOURS"))


SHIFTED_SQL = f"""WITH {events_sql('user_id')}, g AS (
  SELECT floor((epoch_us(ts) - (19736 * 24 + 7) * 3600000000) / 60000000.0)::BIGINT * 60000 - k.k * 60000 AS window_start_ms, sensor_id, count(*) AS cnt, quantile_disc(v, 0.5)::DOUBLE AS p50, quantile_disc(v, 0.99)::DOUBLE AS p99 FROM e, range(5) k(k) GROUP BY 1, 2)
SELECT window_start_ms, sensor_id, cnt, p50, p99 FROM g"""
add("windows_before_epoch", lambda s, d: O.sliding_percentiles(shifted(s, d)).select("window_start_ms", "sensor_id", "cnt", "p50", "p99"), SHIFTED_SQL)
add("windows_from_epoch", lambda s, d: O.from_epoch(O.sliding_percentiles(shifted(s, d))).select("window_start_ms", "sensor_id", "cnt", "p50", "p99"), SHIFTED_SQL + " WHERE window_start_ms >= 0")


def doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with double values, in sevenths."""
    return read_events(spark, sf_dir, scale=None).withColumn("value", F.col("value") / 7)


def tumbling_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means to six decimals: the last bits depend on the order of addition."""
    rows = O.tumbling_stats(doubles(spark, sf_dir), "1 day")
    return rows.select("window_start_ms", "sensor_id", "cnt", F.round("sum_value", 6).alias("sum_value"), "min_value", "max_value", F.round("avg_value", 6).alias("avg_value"))


DAY = "(epoch_us(ts) // 1000) // 86400000 * 86400000 AS window_start_ms"
add("tumbling_doubles", tumbling_doubles, f"WITH {events_sql('user_id', 'value / 7')} SELECT {DAY}, sensor_id, count(*) AS cnt, round(sum(v), 6) AS sum_value, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS avg_value FROM e GROUP BY 1, 2")


def tumbling_doubles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but the sums to the last bit, given as the bits of their IEEE form, all values being positive."""
    day = F.unix_millis(F.window("ts", "1 day")["start"]).alias("window_start_ms")
    rows = doubles(spark, sf_dir)
    sums = exact_sums(rows.select("sensor_id", day, "value"), [F.col("window_start_ms"), F.col("sensor_id")])
    return sums.select("window_start_ms", "sensor_id", "cnt", magnitude_bits(F.col("sum_value")).alias("sum_bits"), F.round("avg_value", 6).alias("avg_value"))


# the sum in whole 2^-70, cut to 53 bits, ties to even; q * 2^r of it is the double
add(
    "tumbling_doubles_exact",
    tumbling_doubles_exact,
    f"""WITH {events_sql('user_id', 'value / 7')}, s AS (SELECT {DAY}, sensor_id, count(*) AS cnt, sum((v * 1180591620717411303424.0)::HUGEINT)::HUGEINT AS t, round(avg(v), 6) AS avg_value FROM e GROUP BY 1, 2),
g AS (SELECT *, greatest(0, CASE WHEN t > 0 THEN floor(log2(t::DOUBLE))::BIGINT - 52 ELSE 0 END) AS about FROM s),
r AS (SELECT *, CASE WHEN t // (2::HUGEINT ** about)::HUGEINT >= 9007199254740992 THEN about + 1 WHEN about > 0 AND t // (2::HUGEINT ** about)::HUGEINT < 4503599627370496 THEN about - 1 ELSE about END AS r FROM g),
q AS (SELECT *, t // (2::HUGEINT ** r)::HUGEINT AS q, 2 * (t % (2::HUGEINT ** r)::HUGEINT) - (2::HUGEINT ** r)::HUGEINT AS more FROM r)
SELECT window_start_ms, sensor_id, cnt, (CASE WHEN t = 0 THEN 0 ELSE (r - 70 + 52 + 1023) * 4503599627370496 + q - 4503599627370496 + CASE WHEN more > 0 OR more = 0 AND q % 2 = 1 THEN 1 ELSE 0 END END)::BIGINT AS sum_bits, avg_value FROM q""",
)
add("sliding_doubles", lambda s, d: O.sliding_from_panes(O.panes(doubles(s, d))).select("window_start_ms", "sensor_id", "cnt", "p50", "p99"), sliding_sql(60_000, "window_start_ms, sensor_id, cnt, q50 AS p50, q99 AS p99", "user_id").replace("value::DECIMAL(18,2)", "value / 7"))
add("sliding_thousandths", lambda s, d: O.sliding_counted(read_events(s, d, "event_type", scale=3), 5, "1 hour", 3_600_000), sliding_sql(3_600_000, SLIDING_COLUMNS, "event_type").replace("DECIMAL(18,2)", "DECIMAL(18,3)"))


def global_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = read_events(spark, sf_dir, "event_type").groupBy("sensor_id", "value").agg(F.count("*").alias("c"))
    return O.ranked_counts(counted, ["sensor_id"]).select("sensor_id", "p50", "p99")


add("global_percentiles", global_percentiles, f"WITH {events_sql('event_type')} SELECT sensor_id, quantile_disc(v, 0.5)::DOUBLE AS p50, quantile_disc(v, 0.99)::DOUBLE AS p99 FROM e GROUP BY 1")
NAN, INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"
#: The events as three groups of doubles: in [0, 1), up to 10^12, and with NaN and infinities.
ANY_RANGE = {
    "unit": "value * 7919 % 1000003 / 1000003",
    "wide": "value * value * value * value",
    "odd": f"CASE WHEN event_id % 5 = 0 THEN {NAN} WHEN event_id % 7 = 0 THEN {INF} WHEN event_id % 11 = 0 THEN -{INF} ELSE value - 50 END",
}


def percentiles_any_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ranks whatever the range, as text with all digits that tell doubles apart."""
    events = read_table(spark, sf_dir, "events").where("value IS NOT NULL")
    rows = events.selectExpr("stack(3, " + ", ".join(f"'{k}', CAST({x} AS DOUBLE)" for k, x in ANY_RANGE.items()) + ") AS (sensor_id, value)")
    found = O.ranked_counts(rows.groupBy("sensor_id", "value").agg(F.count("*").alias("c")), ["sensor_id"])
    return found.select("sensor_id", *[F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), "inf").otherwise(F.format_string("%.12e", c)).alias(c) for c in ("p50", "p99")], "cnt")


def _digits(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN 'inf' ELSE printf('%.12e', {x}) END"


add(
    "percentiles_any_range",
    percentiles_any_range,
    "WITH e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS sensor_id, ({x})::DOUBLE AS v FROM events WHERE value IS NOT NULL" for k, x in ANY_RANGE.items()) + ")"
    f" SELECT sensor_id, {_digits('quantile_disc(v, 0.5)')} AS p50, {_digits('quantile_disc(v, 0.99)')} AS p99, count(*) AS cnt FROM e GROUP BY 1",
)
add(
    "pane_states",
    lambda s, d: O.pane_states(read_events(s, d, "event_type"), "1 hour"),
    f"WITH {events_sql('event_type')} SELECT (epoch_us(ts) // 1000) // 3600000 * 3600000 AS pane_ms, sensor_id, count(*) AS cnt, sum(v)::DOUBLE AS sum_value, min(v)::DOUBLE AS min_value, max(v)::DOUBLE AS max_value, string_agg(v::VARCHAR, ' ' ORDER BY v) AS sorted_values FROM e GROUP BY 1, 2",
)
add(
    "window_assignment",
    lambda s, d: O.assign_windows(read_table(utc(s), d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")).select("event_id", "window_start_ms"),
    "SELECT event_id, (epoch_us(ts) // 1000) // 60000 * 60000 - k.k * 60000 AS window_start_ms FROM events, range(5) k(k) WHERE ts IS NOT NULL",
)
add("key_domain_stats", lambda s, d: O.key_domain(read_events(s, d)), f"WITH {events_sql('user_id')} SELECT min((epoch_us(ts) // 1000) // 60000 * 60000) AS min_minute_ms, max((epoch_us(ts) // 1000) // 60000 * 60000) AS max_minute_ms, count(DISTINCT sensor_id) AS sensors, count(*) AS events FROM e")
add("sensor_name", lambda s, d: read_events(s, d).select("sensor_id").distinct(), f"WITH {events_sql('user_id')} SELECT DISTINCT sensor_id FROM e")
add(
    "horizon_filter",
    lambda s, d: O.within_horizon(read_events(s, d), "2024-01-05T00:00:00Z").select(F.unix_micros("ts").alias("ts_us"), "sensor_id", "value"),
    f"WITH {events_sql('user_id')} SELECT epoch_us(ts) AS ts_us, sensor_id, v::DOUBLE AS value FROM e WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-05' + INTERVAL 1500 MINUTE",
)

#: Lines that a permissive parser drops, but for the one with trailing commas.
ODD_LINES = ["", "a,b", "2025-01-01T00:00:00Z,sensor_1", "2025-01-01T00:00:00Z,sensor_1,1.00,x", "2025-01-01,sensor_1,1.00", "2025-01-01T00:00:00,sensor_1,1.00", "2025-01-01T00:00:00Z,sensor_1,x", "2025-01-01T00:00:00Z,sensor_1,NaN", ",,", "2024-02-01T00:00:00.000Z,sensor_odd,1.50,,"]


def lines_with_odd_ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_events(spark, sf_dir).select(F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "sensor_id", F.col("value").cast("string")).alias("value"))
    return lines.union(spark.createDataFrame([(x,) for x in ODD_LINES], "value string"))


def parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(lines_with_odd_ones(spark, sf_dir)).select(F.unix_millis("ts").alias("ts_ms"), "sensor_id", "value")


add("parse_roundtrip", parse_roundtrip, f"WITH {events_sql('user_id')} SELECT (epoch_us(ts) // 1000) AS ts_ms, sensor_id, v::DOUBLE AS value FROM e UNION ALL SELECT epoch_ms(TIMESTAMP '2024-02-01'), 'sensor_odd', 1.5")


def parse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parse read and dropped, and why, counted while the tumbling windows are made from it."""
    metrics = ParseMetrics()
    written(O.tumbling_stats(parse_lines(lines_with_odd_ones(spark, sf_dir), metrics=metrics)), "parsed-windows")
    return spark.createDataFrame([metrics.counts()], "lines long, not_three_fields long, no_instant long, no_number long, events long")


add("parse_metrics", parse_metrics, f"WITH {events_sql('user_id')} SELECT count(*) + 10 AS lines, 5::BIGINT AS not_three_fields, 2::BIGINT AS no_instant, 2::BIGINT AS no_number, count(*) + 1 AS events FROM e")


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte at which each line begins in the text of all windows in order: sums over ranges, none of which is the whole."""
    windows = O.union_of_both(O.both_in_blocks(read_events(spark, sf_dir)))
    placed = O.numbered(windows, F.octet_length(O.line_of(windows)) + 1)
    return placed.select("offset", O.line_of(placed).alias("line"))


add(
    "line_offsets",
    line_offsets,
    "SELECT (sum(strlen(line) + 1) OVER (ORDER BY kind, start, sensor ROWS UNBOUNDED PRECEDING) - strlen(line) - 1)::BIGINT AS \"offset\", line FROM"
    f" (SELECT line, split_part(line, ',', 1) AS kind, split_part(line, ',', 2)::BIGINT AS start, split_part(line, ',', 3) AS sensor FROM ({ORACLE_SQL['rendered_lines']}))",
)


def changed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the events and a copy with one row changed, one doubled and one missing."""
    rows = read_table(utc(spark), sf_dir, "events").select("event_id", "user_id", "value")
    copy = rows.where("event_id <> 7").withColumn("value", F.when(F.col("event_id") == 42, -1.0).otherwise(F.col("value"))).union(rows.where("event_id = 99"))
    return O.difference(rows, copy, ["event_id"])


add(
    "difference",
    changed_copy,
    "SELECT event_id, user_id, value, 1::BIGINT AS times, 'left' AS side FROM events WHERE event_id IN (7, 42) UNION ALL SELECT event_id, user_id, CASE WHEN event_id = 42 THEN -1 ELSE value END, 1, 'right' FROM events WHERE event_id IN (42, 99)",
)
add("stream_tumbling", lambda s, d: run_to_end(stream_events(s, d), O.tumbling_stats), ORACLE_SQL["tumbling_stats"])
add("stream_sliding", lambda s, d: run_to_end(stream_events(s, d), O.sliding_percentiles), ORACLE_SQL["sliding_percentiles"])


def in_runs(parts: list[DataFrame], windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state after a stream has read the parts one after another, each in a run of its own, from one checkpoint."""
    spark = parts[0].sparkSession
    source, log, offsets = (fresh_path(spark, n) for n in ("stream-source", "window-log", "window-offsets"))
    for part in parts:
        part.write.mode("append").parquet(source)
        rows = spark.readStream.schema(part.schema).parquet(source)
        stream_windows(rows, windows, log, offsets, compact_every=2).awaitTermination()
    return final_state(spark, log).drop("flag")


def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the events in the order of time: the state outlives a run."""
    rows, cuts = read_events(spark, sf_dir), [F.to_timestamp(F.lit(f"2024-01-{d}T00:00:30Z")) for d in ("10", "20")]
    return in_runs([rows.where(F.col("ts") < cuts[0]), rows.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), rows.where(F.col("ts") >= cuts[1])], O.tumbling_stats)


def stream_late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later events first: those before them are behind the watermark when they come."""
    rows, cut = read_events(spark, sf_dir), F.to_timestamp(F.lit("2024-01-10T00:00:00Z"))
    return in_runs([rows.where(F.col("ts") >= cut), rows.where(F.col("ts") < cut)], O.tumbling_stats)


NO_FLAG = TUMBLING_COLUMNS.removesuffix(", 'new' AS flag")
add("stream_restarted", stream_restarted, tumbling_sql(60_000, NO_FLAG, "user_id"))
add("stream_late_dropped", stream_late_dropped, tumbling_sql(60_000, NO_FLAG, "user_id").replace("WHERE ts IS NOT NULL", "WHERE ts >= TIMESTAMP '2024-01-10'"))


def by_time(rows: DataFrame, *days: str) -> list[DataFrame]:
    """The rows before the first of these times, between the first and the second, and so on."""
    cuts = [F.to_timestamp(F.lit(f"2024-01-{d}T00:00:30Z")) for d in days]
    lower, upper = [None, *cuts], [*cuts, None]
    return [rows.where((F.lit(True) if a is None else F.col("ts") >= a) & (F.lit(True) if b is None else F.col("ts") < b)) for a, b in zip(lower, upper)]


def stream_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both window kinds after three runs in the order of time: windows that have closed, once, and those that are open."""
    return current_windows(spark, run_panes(by_time(read_events(spark, sf_dir), "10", "20")))


def stream_late_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later events first; what comes behind the watermark is merged into the windows that had closed."""
    first, second, third = by_time(read_events(spark, sf_dir), "10", "20")
    return corrected_windows(spark, run_panes([second, first, third]))


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event, then the others, with all windows open: each change of a window's values, with those before it."""
    rows = [as_events(read_table(utc(spark), sf_dir, "events").where(F.col("event_id") % 2 == i)) for i in (0, 1)]
    changes = changelog(spark, run_panes(rows, lateness_ms=100 * 86_400_000))
    both = [F.col(f"{side}.{c}").cast("double").alias(f"{side}_{c}") for side in ("before", "after") for c in ("p50", "p99", "cnt", "sum_value")]
    return changes.select("window_type", "window_start_ms", "sensor_id", "flag", *both)


WITH_NO_FLAG = f"SELECT * EXCLUDE (flag) FROM ({ALL_SQL})"
add("stream_panes", stream_panes, WITH_NO_FLAG)
add("stream_late_corrected", stream_late_corrected, WITH_NO_FLAG)
add(
    "stream_changes",
    stream_changes,
    f"WITH first AS (SELECT * FROM ({ALL_SQL.replace('WHERE ts IS NOT NULL', 'WHERE event_id % 2 = 0 AND ts IS NOT NULL')})), whole AS (SELECT * FROM ({ALL_SQL})), r AS (SELECT 'new' AS flag, NULL::DOUBLE AS b50, NULL::DOUBLE AS b99, NULL::DOUBLE AS bc, NULL::DOUBLE AS bs, * EXCLUDE (flag) FROM first"
    " UNION ALL SELECT CASE WHEN f.sensor_id IS NULL THEN 'new' ELSE 'updated' END, f.p50, f.p99, f.cnt, f.sum_value, w.* EXCLUDE (flag) FROM whole w LEFT JOIN first f USING (window_type, window_start_ms, sensor_id)"
    " WHERE f.sensor_id IS NULL OR (f.p50, f.p99, f.cnt, f.sum_value, f.min_value, f.max_value, f.avg_value) IS DISTINCT FROM (w.p50, w.p99, w.cnt, w.sum_value, w.min_value, w.max_value, w.avg_value))"
    " SELECT window_type, window_start_ms, sensor_id, flag, b50 AS before_p50, b99 AS before_p99, bc AS before_cnt, bs AS before_sum_value, p50 AS after_p50, p99 AS after_p99, cnt::DOUBLE AS after_cnt, sum_value AS after_sum_value FROM r",
)


def generated_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether generated events have what the generator promises, within four standard errors."""
    n = 100_000
    made = generate_events(spark, n, partitions=8, numbered=True).withColumn("second", F.unix_seconds("ts") - F.unix_seconds(F.to_timestamp(F.lit("2025-01-01T00:00:00Z"))))
    back = F.floor(F.col("event_id") * 86_400.0 / n) - F.col("second")
    near = lambda x, want, error: F.abs(x - want) < 4 * error
    inner = (F.col("event_id") > 2_000) & (F.col("event_id") < n - 2_000)
    on_time, late = F.when(inner & (back < 60 - 45), back), F.avg((back > 45).cast("double"))
    return made.agg(
        F.count("*").alias("events"),
        F.countDistinct("sensor_id").alias("sensors"),
        near(F.avg(F.col("value").cast("double")), 20, 10 / n**0.5).alias("mean"),
        near(F.stddev(F.col("value").cast("double")), 10, 10 / (2 * n) ** 0.5).alias("deviation"),
        near(F.avg((F.col("value") < 20).cast("double")), 0.5, 0.5 / n**0.5).alias("symmetric"),
        near(late, 0.05, (0.05 * 0.95 / n) ** 0.5 + 0.0004).alias("late_share"),
        (F.max(back) <= 660).alias("at_most_ten_minutes_late"),
        (F.stddev(on_time).between(11, 15)).alias("jitter"),
        (F.min("second") >= -600).alias("from_midnight"),
        (F.max("second") < 86_400).alias("one_day"),
    )


add("generated_statistics", generated_statistics, "SELECT 100000::BIGINT AS events, 1000::BIGINT AS sensors, true AS mean, true AS deviation, true AS symmetric, true AS late_share, true AS at_most_ten_minutes_late, true AS jitter, true AS from_midnight, true AS one_day")
add("generated_events", lambda s, d: generate_events(s, 10_000, partitions=8))
