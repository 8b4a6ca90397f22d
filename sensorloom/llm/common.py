"""What the operators share: tables in the shared folder, splits by checksum, hashing of words."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.session import fresh_path


#: Folders written by this process and not yet removed.
WRITTEN: list[str] = []


def save(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the folder that driver and executors share and read back: cuts the lineage, survives lost executors.

    keep: `scratch` leaves it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if not keep:
        WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at the end, the folders saved meanwhile: for work whose results don't read them any more."""
    first = len(WRITTEN)
    try:
        yield
    finally:
        for path in WRITTEN[first:]:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        del WRITTEN[first:]


#: Spark fills Arrow batches by rows; long texts need a bound in bytes, so that a task holds no thousands of them at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; bounds the session's Arrow batches if nothing does."""
    if spark.conf.get(BATCH_BYTES, None) in (None, str(2**31 - 1)):
        spark.conf.set(BATCH_BYTES, str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def crc32_sql(key: str) -> str:
    """The unsigned crc32 of a whole number's decimal text, in DuckDB's SQL, bit by bit with the reversed polynomial."""
    bits = f"flatten(list_transform(string_split({key}::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::BIGINT), 4294967295)"


def binary(column: str = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = x * MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """Hashes of affixes and n-grams of many distinct, non-empty words at once.

    Code points lie one after another; `starts` and `lengths` say where each word is.
    """

    def __init__(self, words) -> None:
        self.n = len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars = mixed(points.astype(np.uint64) + np.uint64(1))
        self.word_of = np.repeat(np.arange(self.n), self.lengths)
        self.place = np.arange(len(points)) - self.starts[self.word_of]

    def whole(self) -> np.ndarray:
        powers = np.multiply.accumulate(np.full(int(self.lengths.max(initial=0)) + 1, MULTIPLIER, np.uint64))
        return mixed(np.add.reduceat(self.chars * powers[self.place], self.starts)) if self.n else np.zeros(0, np.uint64)

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least so many code points, and the hashes of their beginnings."""
        return self._affix(size, lambda own, i: self.starts[own] + i)

    def suffix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self._affix(size, lambda own, i: self.starts[own] + self.lengths[own] - size + i)

    def _affix(self, size, at):
        own = np.flatnonzero(self.lengths >= size)
        h = np.full(len(own), size, np.uint64)
        for i in range(size):
            h = (h + self.chars[at(own, i)]) * MULTIPLIER
        return own, mixed(h)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word and hash of each n-gram."""
        at = np.flatnonzero(self.place <= self.lengths[self.word_of] - size)
        h = np.full(len(at), size, np.uint64)
        for i in range(size):
            h = (h + self.chars[at + i]) * MULTIPLIER
        return self.word_of[at], mixed(h)


def numbered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word among the distinct ones, and these."""
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return codes, distinct


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row sums of consecutive runs of these lengths, each in its own order: a sum depends on its own values only."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    add = lambda x: np.bincount(own, weights=x, minlength=len(lengths))
    return add(values) if values.ndim == 1 else np.stack([add(x) for x in values.T], axis=1)


WORDLIKE = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters: Unicode's category L, so no fractions, circled digits and the like."""
    found = WORDLIKE.findall(text)
    if "".join(found).isalpha() or not found:
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def chunks(texts: list, most_chars: int = 3_000_000):
    """Index ranges of consecutive texts, or of their sizes, of about so many characters: whole texts, at least one."""
    first = size = 0
    for i, t in enumerate(texts):
        own = t if isinstance(t, int) else len(t or "")
        if i > first and size + own > most_chars:
            yield first, i
            first, size = i, 0
        size += own
    if first < len(texts):
        yield first, len(texts)


def sampled(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows with the `most` smallest distinct hashes of `keys`, one for each, with the hash as `_hash`.

    keys: columns that tell all different rows apart. Only hashes are ranked, in bounded numbers, and the rows
    stay distributed, so neither the driver nor a task gets whole texts. Copies count once: should copies fill
    the first ranks, the distinct hashes are ranked in a second pass.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    ranked = lambda df, n: df.select("_hash").orderBy("_hash").limit(n).collect()
    first = ranked(hashed, 2 * most)
    found = sorted(set(first))
    if len(first) == 2 * most and len(found) < most:
        found = ranked(hashed.select("_hash").distinct(), most)
    near = hashed.where(F.col("_hash") <= F.lit(found[:most][-1][0])) if found else hashed.limit(0)
    return near.dropDuplicates(["_hash"])


def coded(texts: list, longest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words of the texts, words of each, and the distinct words: no list of all words is held.

    longest: longer words are cut into pieces of so many letters; 0: none are.
    """
    seen: dict[str, int] = {}
    parts, lengths = [np.zeros(0, np.int32)], []
    for t in texts:
        found = letter_words((t or "").lower())
        if longest:
            found = [w[i : i + longest] for w in found for i in range(0, len(w), longest)]
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found)))
        lengths.append(len(found))
    distinct = np.empty(len(seen), dtype=object)
    distinct[:] = list(seen)
    return np.concatenate(parts), np.array(lengths, np.int64), distinct


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_added(docs: DataFrame, column: str, run: Callable, added: dict[str, str]) -> DataFrame:
    """docs with columns made in Python from one of them. run(this column of a batch) gives the new ones.

    added: names and types of the new columns, which come last; a name that docs has gets underscores in front,
    so no column of docs is lost or replaced.
    """
    names = {n: free_name(docs, n) for n in added}
    at = docs.columns.index(column)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in added.items())).fields])

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *run(batch.column(at))], names=[*batch.schema.names, *added])

    return rows.mapInArrow(work, schema).toDF(*docs.columns, *names.values())
