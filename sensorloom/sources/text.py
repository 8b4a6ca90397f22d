"""Header-less text events, `time,sensor,value` on each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import utc

#: ISO-8601 with seconds and a zone, in either case; dates alone and zone-less times are no events.
INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{0,9})?(Z|[+-]\d\d:\d\d)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return utc(spark).read.text(path)


def instant(text: Column) -> Column:
    """Timestamp of an ISO-8601 instant, null for any other text.

    The usual form, whole seconds and Z, is known by its length and separators; what lies between them can only be digits
    if Spark reads it. Any other text has to match the pattern; of such, 24:00:00 is the next day's beginning, the leap second
    23:59:60 is the one before it, and a point without digits counts as none.
    """
    usual = (F.length(text) == 20) & text.endswith("Z")
    for at, mark in ((11, "T"), (14, ":"), (17, ":"), (5, "-"), (8, "-")):
        usual &= F.substring(text, at, 1) == mark
    upper = F.upper(text)
    day_end = upper.rlike(r"T24:00:00(\.0*)?[Z+-]")
    plain = F.when(day_end, F.replace(upper, F.lit("T24:"), F.lit("T00:"))).otherwise(F.replace(upper, F.lit("T23:59:60"), F.lit("T23:59:59")))
    other = F.try_to_timestamp(F.regexp_replace(plain, r"\.(?=[Z+-])", ""))
    odd = F.when(upper.rlike(INSTANT), F.when(day_end, other + F.expr("INTERVAL 1 DAY")).otherwise(other))
    return F.coalesce(F.when(usual, F.try_to_timestamp(text)), odd)


class ParseMetrics:
    """Counts of one parse: lines, not_three_fields, no_instant, no_number (with an instant) and events, which add up to lines.

    They are there after the first action on the parsed events, and come from its own pass over the text.
    """

    def __init__(self) -> None:
        self.observations = Observation(), Observation()

    def counts(self) -> dict[str, int]:
        return self.observations[0].get | self.observations[1].get


def parse_lines(lines: DataFrame, column: str = "value", scale: int = 2, lenient: bool = False, metrics: ParseMetrics | str | None = None) -> DataFrame:
    """Events of the lines with exactly three fields, a valid instant and a valid number.

    All other lines are dropped silently. Trailing empty fields don't count, so `a,b,c,` has three.
    Values have `scale` decimals, rounded half up; NaN and infinities are no values.
    lenient: DOUBLE values in any number format that Spark reads, NaN and infinities included.
    metrics: counts what is read and dropped in the same pass, see ParseMetrics; a name, for streams: their progress has the
    counts as <name>_lines and <name>_events.
    """
    line = F.rtrim(F.rtrim(F.col(column), F.lit("\r")), F.lit(","))
    kind = "double" if lenient else f"decimal(18,{scale})"
    # explode() of one value keeps filters above it, so a line is split and read once and not in each filter and column
    once = lambda x: F.explode(F.array(x))
    first, second = metrics.observations if isinstance(metrics, ParseMetrics) else (f"{metrics}_lines", f"{metrics}_events")
    observed = lambda df, to, **counts: df if metrics is None else df.observe(to, *[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in counts.items()])
    split = lines.select(once(F.split(line, ",", -1)).alias("f"))
    fields = observed(split, first, lines=F.lit(True), not_three_fields=F.col("f").isNull() | (F.size("f") != 3)).where(F.size("f") == 3)
    event = F.struct(instant(F.col("f")[0]).alias("ts"), F.col("f")[1].alias("sensor_id"), F.col("f")[2].try_cast(kind).alias("value"))
    no_time, no_value = F.col("e.ts").isNull(), F.col("e.value").isNull()
    events = observed(fields.select(once(event).alias("e")), second, no_instant=no_time, no_number=~no_time & no_value, events=~no_time & ~no_value)
    return events.where("e.ts IS NOT NULL AND e.value IS NOT NULL").select("e.*")


def read_text_events(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_lines(read_lines(spark, path), **options)


def stream_text_events(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_lines(utc(spark).readStream.text(path), **options)
