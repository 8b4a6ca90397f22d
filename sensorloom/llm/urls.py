"""URL filter: rules by host and path, else gradient-boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import sampled, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as verdict, host and path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Words in a host name by which the training URLs are labelled.
SPAM = "casino|pills|bets|spam|adult|ads-track"


@dataclass
class Settings:
    """sample_rows bounds the distinct labelled URLs that the trees are fitted on; suffixes are counted over all.

    most_rows: tables of rules by host and of suffixes are broadcast up to so many rows, counted, and joined by a
    shuffle beyond. folds: a training URL's suffix rate comes from hosts of the other folds.
    """

    sample_rows: int = 4_000
    most_rows: int = 100_000
    folds: int = 5
    trees: int = 12
    depth: int = 4
    smooth: float = 5.0
    seed: int = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: then up to `?`, `#` or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*+", 0)
    return F.translate(host, UPPER, LOWER), path


def small(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """what, host, path and place, the rule's number in the list."""
    values = [F.struct(*(F.lit(x).alias(n) for n, x in zip(("what", "host", "path", "place"), (*r, i)))) for i, r in enumerate(rules)]
    if not values:
        return spark.range(0).select(*(F.lit("").alias(n) for n in ("what", "host", "path")), F.lit(0).alias("place"))
    return spark.range(1).select(F.inline(F.array(*values)))


def with_rules(rows: DataFrame, rules: DataFrame, s: Settings) -> DataFrame:
    """rows (host, path) with `rule`, the longest that fits, as text, and `ruled`, its verdict; null if none. Of equal ones the first counts.

    The rules are one row for each host. A host meets them by its last label, its last two, and so on, as many as a
    rule's host has at most: so many joins, however many rules there are.
    """
    fits = F.struct(F.length(F.concat("host", "path")).alias("size"), (-F.col("place")).alias("place"), F.concat("host", "path").alias("rule"), F.col("path").alias("start"), F.col("what").alias("ruled"))
    by_host = save(rules.groupBy(F.col("host").alias("of")).agg(F.collect_list(fits).alias("own")), "url-rules")
    depth = by_host.agg(F.max(F.size(F.split("of", r"\."))), F.count("*")).first()[0] or 0
    by_host = small(by_host, s.most_rows)
    rows = rows.withColumn("best", F.lit(None).cast(by_host.schema["own"].dataType.elementType))
    for k in range(1, depth + 1):
        met = rows.join(by_host, F.substring_index("host", ".", -k) == F.col("of"), "left")
        longest = F.array_max(F.filter("own", lambda r: F.startswith(F.col("path"), r["start"])))
        rows = met.withColumn("best", F.greatest("best", longest)).drop("of", "own")
    return rows.withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.ruled")}).drop("best")


def entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.length(text).cast("double")
    bits = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(F.length(c) > 0, bits(c) * F.log2(bits(c))).otherwise(0.0))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    count = lambda x, c: (F.length(x) - F.length(F.translate(x, c, ""))).cast("double")
    share = lambda x, c: count(x, c) / F.greatest(F.length(x), F.lit(1))
    query = F.substring_index(F.when(F.instr(url, "?") > 0, F.substring_index(url, "?", -1)).otherwise(""), "#", 1)
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, "."),
        "hyphens": count(host, "-"),
        "depth": count(path, "/"),
        "path_digits": share(path, "0123456789"),
        "host_digits": share(host, "0123456789"),
        "host_entropy": entropy(host),
        "parameters": count(query, "="),
        "secure": url.startswith("https").cast("double"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)).cast("double"),
    }


def with_features(urls: DataFrame) -> DataFrame:
    """url with host, path, suffix (the host's last label) and the features."""
    host, path = host_and_path(F.col("url"))
    named = urls.withColumns({"host": host, "path": path})
    return named.withColumns({"suffix": F.substring_index("host", ".", -1), **lexical(F.col("url"), F.col("host"), F.col("path"))})


FEATURES = ("url_length", "host_length", "labels", "hyphens", "depth", "path_digits", "host_digits", "host_entropy", "parameters", "secure", "longest_label", "suffix_rate")


class UrlModel:
    """Trees, the numbers of blocked and of all labelled URLs by suffix and fold of hosts, and the overall rate."""

    def __init__(self, labelled: DataFrame, s: Settings) -> None:
        """labelled: url, label (1: block). Of the distinct ones the first sample_rows by a hash's order are used for the trees."""
        picked = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("label"))
        host, _ = host_and_path(F.col("url"))
        own = picked.select(F.substring_index(host, ".", -1).alias("suffix"), self._fold(host, s).alias("fold"), "label")
        counts = save(own.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")), "url-suffixes")
        blocked, n = counts.agg(F.sum("blocked"), F.sum("n")).first()
        self.settings, self.rate = s, blocked / n if n else 0.0
        self.folds = counts
        self.totals = small(save(counts.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")), "url-totals"), s.most_rows)
        sample = save(with_features(sampled(picked, ["url", "label"], s.sample_rows).drop("_hash")), "url-sample")
        self.model = None
        if sample.select("label").distinct().count() == 2:
            trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=s.trees, maxDepth=s.depth, seed=s.seed, cacheNodeIds=False)
            self.model = trees.fit(self._vectors(sample, training=True).select("v", "label").coalesce(1))

    @staticmethod
    def _fold(host: Column, s: Settings) -> Column:
        return F.pmod(F.xxhash64(host), F.lit(s.folds)).cast("int")

    def _vectors(self, rows: DataFrame, training: bool = False) -> DataFrame:
        """suffix_rate: over all labelled URLs; in training over those of the other folds, so a label never speaks for itself."""
        s = self.settings
        rated = rows.join(self.totals, "suffix", "left").fillna(0, ["blocked", "n"])
        if training:
            fold = self.folds.select("suffix", "fold", F.col("blocked").alias("own_blocked"), F.col("n").alias("own_n"))
            rated = rated.withColumn("fold", self._fold(F.col("host"), s)).join(small(fold, s.most_rows), ["suffix", "fold"], "left").fillna(0, ["own_blocked", "own_n"])
            rated = rated.withColumns({"blocked": F.col("blocked") - F.col("own_blocked"), "n": F.col("n") - F.col("own_n")}).drop("fold", "own_blocked", "own_n")
        rated = rated.withColumn("suffix_rate", (F.col("blocked") + s.smooth * self.rate) / (F.col("n") + s.smooth)).drop("blocked", "n")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(rated)

    def judged(self, rows: DataFrame) -> DataFrame:
        """rows of with_features with `score`, the probability that the URL is to be blocked."""
        if self.model is None:
            return rows.withColumn("score", F.lit(float(self.rate >= 0.5)))
        return self.model.transform(self._vectors(rows)).withColumn("score", vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction", "suffix_rate")


def filtered(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages.

    rules: (verdict, host, path) each, or a table of what, host, path and place, for long lists. Null urls and those
    without `://` have empty host and path and are judged by the trees. Labels of one kind only, or none, give that
    kind's verdict (none: allow). Repeated rows are judged alike; other columns don't matter; an empty table gives no
    rows. Pages don't move while the tables of rules and suffixes are small enough to broadcast.
    """
    s = settings or Settings()
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, RULES if rules is None else rules)
    model = UrlModel(labelled, s)
    rows = with_rules(model.judged(with_features(pages.select("page_id", "url"))), table, s)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def labelled_by_terms(pages: DataFrame, terms: str = SPAM) -> DataFrame:
    """url and label: 1 if the host's name has one of the terms."""
    host, _ = host_and_path(F.col("url"))
    return pages.where("url IS NOT NULL").select("url", host.rlike(terms).cast("int").alias("label"))


def report(pages: DataFrame) -> DataFrame:
    """filtered() with labels by the host's name. Repeated rows come back each, null urls too; an empty table gives no rows."""
    return filtered(pages, labelled_by_terms(pages))
