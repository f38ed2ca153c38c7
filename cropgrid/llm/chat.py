"""Chat formatting: every dialogue, seen by each of its speakers in turn.

For each participant the whole dialogue is rendered with that speaker as the assistant and all others as
named users; system turns stay system turns. The result has one row for each turn and perspective: the text of
the segment, its place in the rendered dialogue, the place of its content, and whether it is trained on. So a
dialogue of any length is never gathered in one row or task; joined in order of `start`, the segments are the
rendered dialogue.

Defined cases: a null role is the speaker `unknown`, a null text is empty, a null turn stands before all others. Rows of
one turn stand in order of role and text; repeated rows are all rendered. A dialogue of system turns only has no
perspective and so no rows, as has an empty table. Columns other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns of a dialogue that are added up in one window; longer dialogues are added block by block.
BLOCK = 64


def perspectives(turns: DataFrame) -> DataFrame:
    """One row for each turn and speaker of its dialogue: conv_id, speaker, turn, role, name, trained, start, content_start, content_end, end, segment."""
    own = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("said_by"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    speakers = own.where("said_by <> 'system'").groupBy("conv_id", F.col("said_by").alias("speaker")).agg(F.lit(1).alias("_one")).drop("_one")
    seen = own.join(speakers, own.conv_id.eqNullSafe(speakers.conv_id)).drop(speakers.conv_id)
    role = F.when(F.col("said_by") == "system", "system").when(F.col("said_by") == F.col("speaker"), "assistant").otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(F.lit("")), F.lit("\n"))
    shaped = (seen.withColumn("role", role)
              .withColumn("name", F.when(F.col("role") == "user", F.col("said_by")))
              .withColumn("_head", head)
              .withColumn("segment", F.concat("_head", "content", F.lit(CLOSE)))
              .withColumn("_size", F.length("segment").cast("long"))
              .withColumn("_block", F.floor(F.col("turn") / BLOCK)))
    dialogue = ["conv_id", "speaker"]
    inner = Window.partitionBy(*dialogue, "_block").orderBy(F.col("turn").asc_nulls_first(), "said_by", "content").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*dialogue).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (shaped.groupBy(*dialogue, "_block").agg(F.sum("_size").alias("_size"))
              .withColumn("_before", F.coalesce(F.sum("_size").over(outer), F.lit(0))).drop("_size"))
    placed = shaped.withColumn("_within", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    same = placed.conv_id.eqNullSafe(blocks.conv_id) & (placed.speaker == blocks.speaker) & placed._block.eqNullSafe(blocks._block)
    start = F.col("_before") + F.col("_within")
    return placed.join(blocks, same).select(
        placed.conv_id, placed.speaker, "turn", "role", "name", (F.col("role") == "assistant").alias("trained"),
        start.alias("start"), (start + F.length("_head")).alias("content_start"),
        (start + F.col("_size") - len(CLOSE)).alias("content_end"), (start + F.col("_size")).alias("end"), "segment")


SQL = f"""
with own as (select conv_id, turn, coalesce(role, 'unknown') as said_by, coalesce(text, '') as content from conversations),
speakers as (select distinct conv_id, said_by as speaker from own where said_by <> 'system'),
shaped as (
  select o.conv_id, s.speaker, o.turn, o.said_by, o.content,
    case when o.said_by = 'system' then 'system' when o.said_by = s.speaker then 'assistant' else 'user' end as role,
    case when o.said_by <> 'system' and o.said_by <> s.speaker then o.said_by end as name
  from own o join speakers s on o.conv_id is not distinct from s.conv_id),
lined as (
  select *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) as head from shaped),
sized as (
  select *, head || content || '<|im_end|>' || chr(10) as segment, length(head || content) + {len(CLOSE)} as size from lined),
placed as (
  select *, coalesce(sum(size) over (partition by conv_id, speaker order by turn nulls first, said_by, content
    rows between unbounded preceding and 1 preceding), 0)::bigint as start from sized)
select conv_id, speaker, turn, role, name, role = 'assistant' as trained, start, start + length(head) as content_start,
  start + size - {len(CLOSE)} as content_end, start + size as "end", segment from placed
"""
