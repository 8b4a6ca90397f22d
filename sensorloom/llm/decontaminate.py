"""Benchmark decontamination by a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import binary, free_name, save, with_added

#: A-Z to lower case; every other ASCII character but 0-9 and a-z ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """All word sequences of the items. `window`: consecutive words that count as a copy; a shorter item counts whole.

    items: a sequence of words and the ids of the items that are this sequence. Equal items are one sequence, so
    states hold numbers of sequences, never lists of copies.
    """

    def __init__(self, items: list[tuple[list[bytes], list[int]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        self.ids = [ids for _, ids in items]
        texts = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for i, (words, _) in enumerate(items)]
        whole = []
        for i, ids in texts:
            last = 0
            for x in ids:
                last = self._extend(last, x)
            if len(ids) < window:
                whole.append((last, len(ids), i))
        self.shortest = min([window, *(n for _, n, _ in whole)])
        self._label(texts, whole)

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.len) - 1

    def _fork(self, p: int, q: int, x: int) -> int:
        """The state of the sequence at p followed by x, split from q if q has longer ones."""
        if self.len[q] == self.len[p] + 1:
            return q
        own = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._fork(last, self.next[last][x], x)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._fork(p, self.next[p][x], x)
        return new

    def _label(self, texts, whole) -> None:
        """For each state: the one of its last `window` words, the sequences of that, and whole ones that it ends with, of one length each."""
        n = len(self.len)
        self.at_window, self.ends = [-1] * n, [()] * n
        for t, size, i in whole:
            self.ends[t] += ((size, i),)
        for v in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[v]
            if self.len[v] >= self.window:
                self.at_window[v] = v if self.len[up] < self.window else self.at_window[up]
            self.ends[v] += self.ends[up] if up > 0 else ()
        self.items: dict[int, set] = {}
        for i, ids in texts:
            v = 0
            for x in ids:
                v = self.next[v][x]
                if (u := self.at_window[v]) >= 0:
                    self.items.setdefault(u, set()).add(i)

    def match(self, ids: list[int]) -> tuple[list[tuple[int, int]], set, set]:
        """Spans (start, end) of windows in a run of known words, the windows' states, and the whole sequences among them."""
        v = length = 0
        spans, states, found = [], set(), set()
        for at, x in enumerate(ids, 1):
            while v and x not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            if x in self.next[v]:
                v, length = self.next[v][x], length + 1
            if length >= self.window:
                spans.append((at - self.window, at))
                states.add(self.at_window[v])
            for size, i in self.ends[v]:
                if size <= length:
                    spans.append((at - size, at))
                    found.add(i)
        return spans, states, found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list]:
        """Merged spans of a document and its items. Only runs of known words, long enough, are walked."""
        if len(words) < self.shortest:
            return [], []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        edge = np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans, states, items = [], set(), set()
        for s, e in zip(*((x[hi - lo >= self.shortest]).tolist() for x in (lo, hi))):
            got, at, whole = self.match(ids[s:e].tolist())
            spans += [(s + a, s + b) for a, b in got]
            states |= at
            items |= whole
        items.update(*(self.items[u] for u in states))
        return merge(spans), sorted({x for i in items for x in self.ids[i]})


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one each."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the words of these spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


def shards(benchmark: DataFrame, window: int, most_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of at most about so many words, repeated items counting one each; one at a time is in the driver.

    A longer item is cut into pieces that share window - 1 words, so no window is lost.
    """
    found: dict[tuple, list[int]] = {}
    size = 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", binary()).toLocalIterator():
        words = words_of(bytes(row["text"]))
        step = max(1, most_words - window + 1)
        for a in range(0, max(1, len(words) - window + 1), step) if words else ():
            piece = tuple(words[a : a + step + window - 1])
            if found and size + len(piece) > most_words:
                yield SuffixAutomaton(list(found.items()), window)
                found, size = {}, 0
            size += 1 if piece in found else len(piece)
            found.setdefault(piece, []).append(row["item_id"])
    yield SuffixAutomaton(list(found.items()), window)


PAIRS, LONGS = pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())


def _scanned(automaton: SuffixAutomaton, column: pa.Array) -> tuple[list, list, list]:
    n_words, spans, items = [], [], []
    for text in column.cast(pa.binary()):
        words = words_of(text.as_py() or b"")
        got, own = automaton.scan(words)
        n_words.append(len(words))
        spans.append([list(map(int, s)) for s in got])
        items.append(own)
    return n_words, spans, items


def _passes(docs: DataFrame, text: str, automata: Iterator[SuffixAutomaton]) -> DataFrame:
    """The docs with _words, _spans and _items last, from several automata in turn.

    Only what each finds is written, by the row's number; the documents are written once, to hold the numbers.
    """
    spark, names = docs.sparkSession, docs.columns
    rows = save(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    texts = rows.select("row", F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")).cast("binary").alias("text"))
    counted, found = None, None
    for automaton in automata:
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches, shared=shared, first=counted is None):
            for batch in batches:
                n_words, spans, items = _scanned(shared.value, batch.column(1))
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, PAIRS), pa.array(items, LONGS)], names=["row", "n", "s", "i"])
                yield out if first else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

        more = save(texts.mapInArrow(run, "row long, n long, s array<array<bigint>>, i array<bigint>"), "decontaminate-found")
        counted, found = counted or more, more if found is None else found.union(more)
    hits = found.where(F.size("s") > 0).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("_items"))
    joined = hits.withColumn("_spans", F.expr("""aggregate(s, cast(array() AS array<array<bigint>>), (out, x) ->
        if(size(out) > 0 AND x[0] <= element_at(out, -1)[1], concat(slice(out, 1, size(out) - 1), array(array(element_at(out, -1)[0], greatest(element_at(out, -1)[1], x[1])))), concat(out, array(x))))""")).drop("s")
    out = rows.join(counted.select("row", F.col("n").alias("_words")), "row").join(joined, "row", "left")
    empty = lambda c, t: F.coalesce(c, F.expr(f"cast(array() AS {t})"))
    return out.select(*[f"c{i}" for i in range(len(names))], "_words", empty("_spans", "array<array<bigint>>"), empty("_items", "array<bigint>"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = 250_000) -> DataFrame:
    """The docs with _words, _spans (merged [start, end) word spans of copies) and _items (their item_ids, sorted), as the last columns.

    docs: text and any other columns, which stay; where they have these names already, the new ones get further
    underscores in front. A window is `window` consecutive words of an item; an item of fewer words, but not none,
    is one window. Null texts have no words; items without id or text take no part; repeated rows count each,
    repeated item_ids once. Each document streams once through the automaton, in bounded memory. The automaton is
    sent to the executors: a benchmark of over `most_words` words is cut into several, which the documents meet one
    after the other, so that no task holds two of them.
    """
    automata = shards(benchmark, window, most_words)
    first, second = next(automata), next(automata, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(column):
            return [pa.array(x, t) for x, t in zip(_scanned(shared.value, column), (pa.int64(), PAIRS, LONGS))]

        return with_added(docs, "text", run, {"_words": "bigint", "_spans": "array<array<bigint>>", "_items": "array<bigint>"})

    def all_() -> Iterator[SuffixAutomaton]:
        yield first
        yield second
        yield from automata

    return _passes(docs, "text", all_()).toDF(*docs.columns, *(free_name(docs, n) for n in ("_words", "_spans", "_items")))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs.

    Null and empty texts have no words; a null doc_id stays; other columns don't matter. Without items nothing is
    hit. An empty table gives no rows.
    """
    found = contamination(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    ids = F.concat_ws(",", F.array_sort(F.transform("_items", lambda i: i.cast("string"))))
    return found.select("doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, longest: int = 9, coverage: float = 0.5) -> DataFrame:
    """The docs less spans of over `longest` words; documents with over this share of copied words go whole.

    All columns of docs stay as they are, whatever their names; other texts than those that lose a span do too,
    null ones included. Repeated rows are treated alike. An empty table gives no rows.
    """
    at = docs.columns.index("text")
    names = [f"text{i}" if i == at else f"c{i}" for i in range(len(docs.columns))]
    found = contamination(docs.toDF(*names).withColumnRenamed(names[at], "text"), benchmark, window)
    names[at] = "text"
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    kept = found.where((hit == 0) | (hit <= F.col("_words") * coverage))
    if coverage > 0:
        schema = kept.select(*names).schema

        def cut(batches):
            for batch in batches:
                texts, changed = batch.column(at), False
                spans = [[s for s in x if s[1] - s[0] > longest] for x in batch.column(len(names) + 1).to_pylist()]
                if any(spans):
                    changed = [without(t.encode(), s).decode("utf-8", "replace") if s else t for t, s in zip(texts.to_pylist(), spans)]
                yield pa.RecordBatch.from_arrays([pa.array(changed, texts.type) if i == at and changed else batch.column(i) for i in range(len(names))], names=names)

        kept = kept.mapInArrow(cut, schema)
    return kept.select(*names).toDF(*docs.columns)


def cleaned_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_chars and text_sha256 of what decontaminate leaves of each document.

    A null text counts as empty here. Repeated rows come back each, rows without doc_id too; an empty table gives no rows, and
    an empty benchmark leaves every text as it is.
    """
    left = decontaminate(docs.select("doc_id", "text"), benchmark, window)
    text = F.coalesce(F.col("text"), F.lit(""))
    return left.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


#: The report in DuckDB's SQL.
SQL = r"""WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d JOIN (SELECT DISTINCT n FROM g) ON len(w) >= n)),
m AS (SELECT r, n, i, item_id FROM p JOIN g USING (n, g)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""

_HITS = SQL[: SQL.index("SELECT doc_id, len(w)::BIGINT AS n_words")].rsplit("),\nt AS", 1)[0].replace("SELECT row_number() OVER () AS r, doc_id,", "SELECT row_number() OVER () AS r, doc_id, text,").replace("SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM m) GROUP BY r", "SELECT DISTINCT r, unnest(range(i, i + n)) + 1 AS x FROM m")
#: The cleaned report: runs of hit words of over nine words go with what stands between them, and documents of over half hit words.
CLEANED_SQL = _HITS + r"""),
runs AS (SELECT r, x - row_number() OVER (PARTITION BY r ORDER BY x) AS run, x FROM h),
spans AS (SELECT r, min(x) AS a, max(x) AS b FROM runs GROUP BY r, run),
cut AS (SELECT r, list(struct_pack(a := a, b := b)) FILTER (b - a + 1 > 9) AS s, sum(b - a + 1) AS n_hit FROM spans GROUP BY r),
k AS (SELECT doc_id, coalesce(text, '') AS text, len(w) AS n, coalesce(s, []) AS s FROM d LEFT JOIN cut USING (r) WHERE coalesce(n_hit, 0) <= 0.5 * len(w)),
e AS (SELECT *, string_split_regex(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS sep, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS word FROM k),
f AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN text ELSE array_to_string(list_transform(range(1, n + 2), lambda i: CASE WHEN len(list_filter(s, lambda z: z.a < i AND i <= z.b)) > 0 THEN '' ELSE sep[i] END || CASE WHEN i > n OR len(list_filter(s, lambda z: z.a <= i AND i <= z.b)) > 0 THEN '' ELSE word[i] END), '') END AS text FROM e)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM f"""
