"""Chat formatting by prefix-target expansion. DataFrame functions only.

A turn is `### role: text</turn>` and a line feed. Inside roles and texts a backslash escapes itself,
every `#`, and the slash of `</`, in roles also `:`; so no control string is left in them, and dropping
the backslash of each pair gives back what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conv_id, example, text, loss_start (from 1) and loss_length, in code points, of the trainable reply.

    turns: conv_id, turn, role, text, and any other columns. Every turn of the trainable role is an
    example of its own: all turns up to it, only its text trainable. A conversation that doesn't end
    with one has a last example with all its turns and nothing trainable, so no turn is lost. Rows come
    in the order of turn, then role, then text, nulls first; null roles and texts are empty. Rows with
    null conv_id are one conversation. Examples repeat their context, so the output of a conversation
    grows with the square of its turns; it is made after the one shuffle and is never shuffled. Repeated rows are
    turns each; other columns don't matter. An empty table gives no rows.
    """
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = filled.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), F.replace(escape(x["role"]), F.lit(":"), F.lit("\\:")), F.lit(MIDDLE))
    parts = whole.withColumn("parts", F.transform("t", lambda x: F.struct(head(x).alias("head"), escape(x["text"]).alias("body"), (x["role"] == trainable).alias("own"))))
    at = parts.select("conv_id", "parts", F.posexplode("parts").alias("i", "part")).where(F.col("part.own") | (F.col("i") == F.size("parts") - 1))
    piece = lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))
    made = at.withColumn("before", F.array_join(F.transform(F.slice("parts", 1, F.col("i")), piece), ""))
    return made.select(
        "conv_id",
        F.col("i").alias("example"),
        F.concat("before", piece(F.col("part"))).alias("text"),
        F.when(F.col("part.own"), F.length("before") + F.length("part.head") + 1).alias("loss_start"),
        F.when(F.col("part.own"), F.length("part.body")).otherwise(0).alias("loss_length"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) of a formatted text."""
    pieces = F.split(text, CLOSE, -1)
    header = r"(?s)^### ((?:[^\\:]++|\\.)*+): "

    def turn(p: Column) -> Column:
        raw = F.regexp_extract(p, header, 1)
        return F.struct(unescape(raw).alias("role"), unescape(F.substring(p, F.length(raw) + len(OPEN) + len(MIDDLE) + 1, F.length(p))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the examples alone."""
    loss = unescape(F.when(F.col("loss_length") > 0, F.substring("text", F.col("loss_start"), F.col("loss_length"))).otherwise(""))
    grouped = formatted.groupBy("conv_id").agg(F.max_by("text", "example").alias("last"), F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("l"), F.sum(F.length("text")).alias("formatted_chars"))
    read = grouped.select("conv_id", read_turns(F.col("last")).alias("turns"), F.array_join("l.loss", "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


#: A conversation whose texts hold control strings.
HARD = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def report(turns: DataFrame) -> DataFrame:
    """What is read back from the examples of all conversations and of one whose texts hold control strings.

    Null conv_id is a conversation of its own, null role and text are empty, repeated rows are turns each; an empty table
    leaves the added conversation. Other columns don't matter.
    """
    hard = turns.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', r'{x}')" for c, t, r, x in HARD) + " AS v(conv_id, turn, role, text)")
    return read_back(examples(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(hard)))


SQL = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  14 + length(replace(replace(replace(replace(role, '\\', '\\\\'), '#', '\\#'), '</', '<\\/'), ':', '\\:')) + length(replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '</', '<\\/')) AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars FROM p GROUP BY conv_id"""
