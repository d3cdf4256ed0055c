"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of ``>`` it starts with. Runs of lines of one level above 0 are quoted passages; their normalised text is
hashed and linked to the latest earlier message of the conversation that has this text as its body, a paragraph or a line. A message replies
to the first message that it quotes directly, or else to the one before it, and is kept without its quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import checkpoint

#: Turns that are numbered together; a conversation of any length is dealt out by such blocks.
BLOCK = 4096
# Fixed value: leading quote markers.
MARKS = r"^(?:[ \t]*>)+"
_GAP = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """Array of struct(level, body) in order."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        body = F.when(level > 0, F.regexp_replace(F.substr(line, F.length(marks) + 1), "^ ", "")).otherwise(line)
        return F.struct(level.cast("int").alias("level"), body.alias("body"))

    return F.transform(lines, parsed)


def normal(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), _GAP, " "))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, key (of all three and the text), body, depth and passages of each message; null text counts as empty.

    ``passages`` is an array of struct(level, body): runs of lines of one level above 0, in order. Lines, starts of runs and runs are
    columns of their own, each made from the last, so the work is linear in a message's lines; the result is written, as a filter on it would
    otherwise be pushed below them and have the text split again for every line.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.xxhash64("conv_id", "turn", "role", "text").alias("key"), text.alias("text"),
    )
    # a text without a mark has no quoted line, so its lines stay null
    lines = rows.withColumn("lines", F.when(F.contains("text", F.lit(">")), _lines(F.col("text"))))
    size = F.size("lines")
    levels = lines.withColumn("levels", F.transform("lines", lambda x: x["level"]))
    begins = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    starts = levels.withColumn("starts", begins)

    def run(at: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), size)
        inside = F.slice("lines", at + 1, stop - at)
        return F.struct(F.get("levels", at).alias("level"), F.array_join(F.transform(inside, lambda x: x["body"]), "\n").alias("body"))

    runs = starts.withColumn("runs", F.transform("starts", run))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    depth = F.coalesce(F.array_max("levels"), F.lit(0))
    return checkpoint(runs.select(
        "conv_id", "turn", "role", "key",
        F.when(depth > 0, F.trim(F.regexp_replace(own, r"\n{3,}", "\n\n"))).otherwise(F.col("text")).alias("body"), depth.alias("depth"),
        F.filter("runs", lambda r: (r["level"] > 0) & (normal(r["body"]) != "")).alias("passages"),
    ))


NAMES = ("conv_id", "turn", "role", "key")


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, passage, level, source_turn): the latest earlier message of the conversation that each passage quotes, null if none does.

    Originals and quotes of one text meet in a window by turn, so the work is linear however often a text recurs.
    """
    quotes = (
        parsed.where(F.size("passages") > 0)
        .select(*NAMES, F.posexplode("passages").alias("passage", "p"))
        .distinct()
        .select(*NAMES, "passage", F.col("p.level").alias("level"), F.xxhash64(normal(F.col("p.body"))).alias("text"))
    )
    wanted = quotes.select(F.col("conv_id").alias("in_conv"), F.col("text").alias("wanted")).distinct()
    units = F.array_distinct(F.concat(F.array(F.col("body")), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")))
    originals = (
        parsed.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, lambda u: F.xxhash64(normal(u))))).alias("text"))
        .join(wanted, F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("text") == F.col("wanted")), "left_semi")
        .distinct()
    )
    both = quotes.withColumn("from", F.lit(None).cast("long")).unionByName(originals.withColumn("from", F.col("turn")), allowMissingColumns=True)
    # RANGE up to turn - 1: a message does not quote its own turn
    before = Window.partitionBy("conv_id", "text").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("source_turn", F.max("from").over(before)).where("key IS NOT NULL").select(*NAMES, "passage", "level", "source_turn")


def conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per message: conv_id, turn, role, position (from 1), reply_to, body, depth, n_quotes, n_linked.

    ``position`` orders a conversation so that every message follows the one it replies to. Messages of equal turn are ordered by role and
    text; repeated rows keep their own positions. Null text is an empty body; rows with null conv_id form a conversation of their own, null
    turns come first and have no previous turn. An empty table gives no rows; other columns are ignored.
    """
    parsed = parse(messages)
    links = link(parsed)
    per_message = links.groupBy(*[F.col(c).alias(f"of_{c}") for c in NAMES]).agg(
        F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked"),
        F.min_by("source_turn", F.when((F.col("level") == 1) & F.col("source_turn").isNotNull(), F.col("passage"))).alias("quoted"),
    )
    rows = parsed.drop("passages").withColumn("block", F.floor(F.col("turn") / block))
    stretch = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    rows = rows.withColumn("_at", F.row_number().over(stretch)).withColumn(
        "_prev", F.max("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("conv_id", "block").agg(F.count("*").alias("_n"), F.max("turn").alias("_last"))
        .select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.max("_last").over(earlier).alias("_last"))
    )
    placed = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")))
    same = F.lit(True)
    for c in NAMES:
        same = same & (F.col(c) == F.col(f"of_{c}") if c == "key" else F.col(c).eqNullSafe(F.col(f"of_{c}")))
    return placed.join(per_message, same, "left").select(
        "conv_id", "turn", "role",
        (F.col("_before") + F.col("_at")).alias("position"),
        F.coalesce("quoted", "_prev", "_last").alias("reply_to"),
        "body", "depth",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def chat_text(formatted: DataFrame, segment: int = 64) -> DataFrame:
    """(conv_id, segment, chat): bodies in order with their roles, ``segment`` messages to a row so that no conversation is one row."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return (
        formatted.withColumn("segment", F.floor((F.col("position") - 1) / segment)).groupBy("conv_id", "segment")
        .agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])).alias("chat"))
    )


ORACLE_SQL = r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS rid FROM conversations),
l AS (
  SELECT rid, i, line, length(regexp_replace(marks, '[^>]', '', 'g'))::INT AS level,
         CASE WHEN marks <> '' THEN regexp_replace(substr(line, length(marks) + 1), '^ ', '') ELSE line END AS body
  FROM (SELECT rid, i, ls[i] AS line, regexp_extract(ls[i], '^(?:[ \t]*>)+') AS marks
        FROM (SELECT rid, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM m WHERE contains(text, '>')) t,
             LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))),
own AS (SELECT rid, trim(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS body, max(level) AS depth FROM l GROUP BY rid),
msg AS (SELECT m.conv_id, m.turn, m.role, m.rid, m.text, coalesce(own.body, m.text) AS body, coalesce(own.depth, 0) AS depth FROM m LEFT JOIN own USING (rid)),
runs AS (SELECT *, sum(CASE WHEN level = prev THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run
         FROM (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY i) AS prev FROM l)),
p AS (SELECT rid, run, any_value(level) AS level, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY i)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS q
      FROM runs WHERE level > 0 GROUP BY rid, run),
q AS (SELECT p.rid, run, level, q, conv_id, turn FROM p JOIN msg USING (rid) WHERE q <> ''),
u AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS q
      FROM (SELECT conv_id, turn, unnest(list_concat([body], list_concat(regexp_split_to_array(body, '\n[ \t]*\n'), string_split(body, chr(10))))) AS unit FROM msg)),
s AS (SELECT q.rid, q.run, q.level, max(u.turn) AS source FROM q LEFT JOIN u ON u.conv_id IS NOT DISTINCT FROM q.conv_id AND u.q = q.q AND u.turn < q.turn GROUP BY ALL),
per AS (SELECT rid, count(*) AS n_quotes, count(source) AS n_linked, arg_min(source, run) FILTER (WHERE level = 1 AND source IS NOT NULL) AS quoted FROM s GROUP BY rid)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position,
       coalesce(quoted, max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reply_to,
       body, depth, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
FROM msg LEFT JOIN per USING (rid)
"""
