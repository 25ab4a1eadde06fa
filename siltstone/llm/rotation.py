"""Multi-party perspective rotation of conversations.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and the others as named users; the mask covers what the assistant says and the marker
that closes it. System turns keep their role in every perspective.

A rendering is a row for each turn with its place in the rendered text, so a conversation of any
length stays spread over tasks; ``segment`` in the order of ``seq`` gives the text. Running
lengths are two-level: sums of runs of turns, then the turns of a run.

Built from DataFrame functions alone. Defined results: a null or empty role is the speaker
``unknown``; a null text is empty; a null turn comes first; equal turns go by speaker and then
text; repeated rows are rendered each; a conversation with system turns only has no participant
and no rows; a null ``conv_id`` is a conversation of its own. Markers inside texts and names are broken up, and names lose line ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table


@dataclass(frozen=True)
class ChatTemplate:
    opens: str = "<|im_start|>"
    closes: str = "<|im_end|>\n"
    #: What marks the template's own markers, and what stands for it in texts and names.
    marker: str = "<|"
    broken: str = "< |"
    #: Turns whose lengths are summed up together.
    run_turns: int = 64


def rotate(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Rows (conv_id, participant, seq, turn, speaker, segment, char_start, char_end, mask_start,
    mask_end) from rows (conv_id, turn, role, text); the mask is empty where nothing is learned."""
    plain = turns.select(
        F.struct(F.col("conv_id").isNull().alias("missing"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("conv"), "turn",
        F.regexp_replace(F.replace(F.coalesce(F.expr("nullif(role, '')"), F.lit("unknown")), F.lit(template.marker), F.lit(template.broken)), r"[\r\n]", " ").alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit(template.marker), F.lit(template.broken)).alias("text"),
        F.coalesce(F.floor(F.col("turn") / template.run_turns), F.lit(-(1 << 62))).alias("run"),
    )
    participants = plain.where("speaker <> 'system'").select("conv", F.col("speaker").alias("participant")).distinct()
    seen = plain.join(participants, "conv")
    own = F.col("speaker") == F.col("participant")
    head = F.concat(F.lit(template.opens), F.when(own, F.lit("assistant\n")).when(F.col("speaker") == "system", F.lit("system\n")).otherwise(F.concat(F.lit("user name="), F.col("speaker"), F.lit("\n"))))
    seen = seen.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(template.closes))).withColumn("length", F.length("segment").cast("long"))

    view = ["conv", "participant"]
    runs = seen.groupBy(*view, "run").agg(F.sum("length").alias("run_length"), F.count("*").alias("run_turns"))
    earlier = Window.partitionBy(*view).orderBy("run")
    runs = runs.select(*view, "run", (F.sum("run_length").over(earlier) - F.col("run_length")).alias("chars_before"), (F.sum("run_turns").over(earlier) - F.col("run_turns")).alias("turns_before"))
    inside = Window.partitionBy(*view, "run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("until", F.sum("length").over(inside)).withColumn("nth", F.count("*").over(inside)).join(runs, [*view, "run"])
    end = F.col("chars_before") + F.col("until")
    return placed.select(
        F.when(~F.col("conv.missing"), F.col("conv.id")).alias("conv_id"), "participant", (F.col("turns_before") + F.col("nth") - 1).alias("seq"), "turn", "speaker", "segment",
        (end - F.col("length")).alias("char_start"), end.alias("char_end"),
        F.when(own, end - F.col("length") + F.length("head")).otherwise(end).alias("mask_start"), end.alias("mask_end"),
    )


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read_table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH plain AS (
  SELECT conv_id, turn, regexp_replace(replace(coalesce(nullif(role, ''), 'unknown'), '<|', '< |'), '[\\r\\n]', ' ', 'g') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), participants AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM plain WHERE speaker <> 'system'
), seen AS (
  SELECT p.*, q.participant,
         '<|im_start|>' || CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM plain p JOIN participants q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
), whole AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM seen
), placed AS (
  SELECT *, sum(length(segment)) OVER w AS char_end, row_number() OVER w - 1 AS seq
  FROM whole
  WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, participant, seq::bigint AS seq, turn, speaker, segment, (char_end - length(segment))::bigint AS char_start, char_end::bigint AS char_end,
       (CASE WHEN speaker = participant THEN char_end - length(segment) + length(head) ELSE char_end END)::bigint AS mask_start, char_end::bigint AS mask_end
FROM placed
"""
