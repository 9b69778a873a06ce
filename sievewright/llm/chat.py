"""Chat formatting: one rendering of a dialogue for each of its participants.

In the rendering of a participant that speaker is the assistant and everyone
else a user with a name; only the assistant's words are trained on. Built-in
expressions only: one shuffle by dialogue, which moves each turn once; the
renderings are made after it, a row at a time.

A text cannot forge a turn: a mark inside it gets a backslash, which unescaped()
takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """text with one more backslash in whatever looks like a mark."""
    return F.regexp_replace(text, r"<\|(\\*)im_", r"<|\\$1im_")


def unescaped(text: Column) -> Column:
    """The text that escaped() was given."""
    return F.regexp_replace(text, r"<\|\\(\\*)im_", "<|$1im_")


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrator: str = "system") -> DataFrame:
    """One row for each dialogue and participant: conv_id, speaker, n_turns, n_own_turns, rendered, mask_runs, n_trained.

    A turn is rendered as `<|im_start|>NAME\\nTEXT<|im_end|>\\n`; NAME is `assistant` for the row's speaker, `user name=SPEAKER` for another and the narrator's own name for the narrator, who is no participant. Marks in a text or a name are escaped, and line ends in a name are `\\n` in two characters. mask_runs has for each turn `M:T`: M characters that are masked, then T that are trained on (text and end mark of the assistant); the runs add up to the whole rendering, and all T to n_trained.
    Every participant of the dialogue gets the whole of it, however long. Turns go by number, then speaker, then text, nulls first; repeated rows are turns of their own. A null speaker is `unknown`, a null text is empty. A turn without a dialogue id is a dialogue of its own. A dialogue of the narrator alone has no participant and gives no row. An empty table gives an empty result; other columns are not read.
    A rendering is one value, so a dialogue's turns meet in one task, and 2 GB of UTF-8, Spark's limit of a value, is the longest rendering; a longer one fails, it is not cut.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{speaker_col}`").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    dialogues = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    speakers = F.filter(F.array_distinct(F.transform("turns", lambda t: t["speaker"])), lambda s: s != narrator)
    each = dialogues.select("conv_id", "turns", F.explode(speakers).alias("speaker"))
    own = F.col("speaker")

    def shown(speaker):
        return F.replace(F.replace(escaped(speaker), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))

    def name(t):
        return F.when(t["speaker"] == own, "assistant").when(t["speaker"] == narrator, F.lit(narrator)).otherwise(F.concat(F.lit("user name="), shown(t["speaker"])))

    def head(t):
        return F.concat(F.lit(START), name(t), F.lit("\n"))

    def body(t):
        return F.concat(escaped(t["text"]), F.lit(END + "\n"))

    def trained(t):
        return F.when(t["speaker"] == own, F.length(body(t))).otherwise(0)

    def runs(t):
        return F.concat_ws(":", (F.length(head(t)) + F.length(body(t)) - trained(t)).cast("string"), trained(t).cast("string"))

    return each.select(
        "conv_id",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["speaker"] == own)).cast("long").alias("n_own_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), body(t))), "").alias("rendered"),
        F.array_join(F.transform("turns", runs), " ").alias("mask_runs"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + trained(t)).alias("n_trained"),
    )


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def _escaped_sql(x: str) -> str:
    return rf"regexp_replace({x}, '<\|(\\*)im_', '<|\\\1im_', 'g')"


SQL = f"""
WITH t AS (
  SELECT CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, conv_id, turn, coalesce(role, 'unknown') AS speaker,
         coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, alone, speaker FROM t WHERE speaker <> 'system'),
p AS (
  SELECT s.conv_id, s.alone, s.speaker, t.turn, t.speaker AS said_by, t.text, t.speaker = s.speaker AS own,
         '{START}' || CASE WHEN t.speaker = s.speaker THEN 'assistant' WHEN t.speaker = 'system' THEN 'system'
           ELSE 'user name=' || replace(replace({_escaped_sql("t.speaker")}, chr(13), '\\r'), chr(10), '\\n') END || chr(10) AS head,
         {_escaped_sql("t.text")} || '{END}' || chr(10) AS body
  FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.alone IS NOT DISTINCT FROM s.alone)
SELECT conv_id, speaker, count(*) AS n_turns, count_if(own)::BIGINT AS n_own_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, said_by, text) AS rendered,
       string_agg(CASE WHEN own THEN length(head) || ':' || length(body) ELSE (length(head) + length(body)) || ':0' END, ' ' ORDER BY turn NULLS FIRST, said_by, text) AS mask_runs,
       sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS n_trained
FROM p GROUP BY conv_id, alone, speaker
"""
