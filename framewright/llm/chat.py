"""Multi-party chats from every participant's side: that speaker is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import numbered, table

#: The markup of a message: BEGIN role [name=...] line feed content END. SYSTEM messages have no speaker.
BEGIN, NAME, END, SYSTEM, UNKNOWN = "<|im_start|>", " name=", "<|im_end|>\n", "system", "unknown"
#: Offsets are summed within so many turns, and over such blocks.
BLOCK = 256


def escaped(text: F.Column) -> F.Column:
    """Markup within a text gets a backslash (one more, if it has some) before its bar, so that no message can end itself or begin another."""
    return F.regexp_replace(text, r"<(\\*)\|im_", r"<$1\\|im_")


def rotate(turns: DataFrame) -> DataFrame:
    """A row for each message and perspective: conv_id, perspective, turn, author, chat_role, name, content, segment, start, n_chars, loss, loss_start, loss_chars.

    A dialogue as seen by a perspective is its segments in the order of start; segments follow each other without a gap. loss says
    that the perspective speaks; what is learnt then is loss_chars characters from loss_start on: the content and the end's markup,
    not the head (0 characters in other segments). Markup in contents and names is escaped(), and line feeds in names are spaces. Messages are ordered by turn (null: last), then by author and
    md5 of the content; repeated rows are messages of their own. System messages stay system messages for everybody; a
    conversation without a speaker gives no rows. Null role: a speaker called unknown. Null text: empty. Null conv_id: one
    conversation. Empty table: no rows. Other columns are not read.

    Lengths, not texts, pass through the sums; each text is shuffled once, and no conversation is gathered in a row or a task.
    """
    source = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("author"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    rows = numbered(source, "turns", "_row")
    system = F.col("author") == SYSTEM
    speakers = rows.where(~system).select(F.col("conv_id").alias("_conv"), F.col("author").alias("perspective")).distinct()
    chat_role = F.when(F.col("author") == F.col("perspective"), "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~system & (F.col("author") != F.col("perspective")), F.col("author"))
    label = F.regexp_replace(escaped(F.col("name")), "[\r\n]+", " ")
    head = F.concat(F.lit(BEGIN), F.col("chat_role"), F.coalesce(F.concat(F.lit(NAME), label), F.lit("")), F.lit("\n"))

    narrow = rows.select("conv_id", "turn", "author", F.md5(F.col("content").cast("binary")).alias("_md5"), F.length(escaped(F.col("content"))).alias("_n"), "_row")
    seen = narrow.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    seen = seen.withColumn("chat_role", chat_role).withColumn("name", name).withColumn("_head", head)
    seen = seen.withColumn("n_chars", (F.length("_head") + F.col("_n") + len(END)).cast("long"))
    seen = seen.withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**60)))
    side = ["conv_id", "perspective"]
    inside = Window.partitionBy(*side, "_block").orderBy(F.col("turn").asc_nulls_last(), "author", "_md5", "_row").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_in", F.coalesce(F.sum("n_chars").over(inside), F.lit(0)))
    totals = seen.groupBy(*side, "_block").agg(F.sum("n_chars").alias("_sum"))
    earlier = Window.partitionBy(*side).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    placed = seen.join(totals, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    placed = placed.select("_row", "perspective", "chat_role", "name", "_head", (F.col("_in") + F.col("_before")).alias("start"), "n_chars")
    own = F.col("chat_role") == "assistant"
    return rows.join(placed, "_row").select(
        "conv_id",
        "perspective",
        "turn",
        "author",
        "chat_role",
        "name",
        "content",
        F.concat("_head", escaped(F.col("content")), F.lit(END)).alias("segment"),
        "start",
        "n_chars",
        own.alias("loss"),
        (F.col("start") + F.length("_head")).cast("long").alias("loss_start"),
        F.when(own, F.col("n_chars") - F.length("_head")).otherwise(0).cast("long").alias("loss_chars"),
    )


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP3_SQL = f"""
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '{UNKNOWN}') AS author, coalesce(text, '') AS content FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS c, author AS perspective FROM m WHERE author <> '{SYSTEM}'
), j AS (
  SELECT m.*, p.perspective,
    CASE WHEN author = perspective THEN 'assistant' WHEN author = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS chat_role,
    CASE WHEN author <> perspective AND author <> '{SYSTEM}' THEN author END AS name
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.c
), h AS (
  SELECT *, '{BEGIN}' || chat_role || coalesce('{NAME}' || regexp_replace(regexp_replace(name, '<(\\\\*)\\|im_', '<\\1\\\\|im_', 'g'), '[\\r\\n]+', ' ', 'g'), '') || chr(10) AS head,
    regexp_replace(content, '<(\\\\*)\\|im_', '<\\1\\\\|im_', 'g') || '<|im_end|>' || chr(10) AS rest FROM j
), s AS (
  SELECT *, head || rest AS segment FROM h
), o AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, author, md5(content)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s
)
SELECT conv_id, perspective, turn, author, chat_role, name, content, segment, start,
  CAST(length(segment) AS BIGINT) AS n_chars, chat_role = 'assistant' AS loss, CAST(start + length(head) AS BIGINT) AS loss_start,
  CAST(CASE WHEN chat_role = 'assistant' THEN length(rest) ELSE 0 END AS BIGINT) AS loss_chars
FROM o
"""
