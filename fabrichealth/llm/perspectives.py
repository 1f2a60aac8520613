"""Multi-party perspective rotation of chats, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the
others as named users; the mask marks the characters of the speaker's own turns. A dialogue is rendered in
parts of ``part_turns`` turn numbers: joined in order of ``part`` the parts give the whole dialogue, and most
conversations have one part. Turns that share a number stay in one part. ``start`` is the part's place in the whole
rendered dialogue, cumulated from lengths alone: texts are dealt by conversation and part, so a long conversation
spreads over tasks. ``mask`` holds spans ``from-to`` in code points within the part.

Order: turn (nulls first), then role, then text. Equal rows count once. Null role: the participant
``unknown``; null text: empty; null conv_id: a conversation of its own. Extra columns are ignored, an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TURNS = 256
#: The heads of turns.
ASSISTANT, USER, END = "<|assistant|>\n", "<|user name=", "|>\n"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, start, n_turns, n_spoken, rendered, mask of ``turns(conv_id, turn, role, text)``."""
    rows = turns.select(
        "conv_id",
        F.col("conv_id").isNull().alias("_nil"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"),
        F.coalesce(F.floor(F.col("turn").cast("long") / part_turns), F.lit(-1).cast("long")).alias("_chunk"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    conv, part = ["_nil", "_conv"], ["_nil", "_conv", "_chunk"]
    texts = rows.groupBy(*part).agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    told = rows.groupBy(*part, "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    as_user = lambda role: F.length(F.lit(USER)) + F.length(role) + F.length(F.lit(END))
    sizes = told.groupBy(*part).agg(
        F.sum(F.col("n") * (as_user(F.col("role")) + 1) + F.col("chars")).alias("size"),
        F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("by_role"),
    )
    places = sizes.join(told.select(*conv, F.col("role").alias("speaker")).distinct(), conv)
    size = F.col("size") - F.coalesce(F.try_element_at("by_role", F.col("speaker")), F.lit(0)) * (as_user(F.col("speaker")) - F.length(F.lit(ASSISTANT)))
    before = W.partitionBy(*conv, "speaker").orderBy("_chunk")
    places = places.select(*part, "speaker", (F.row_number().over(before) - 1).cast("long").alias("part"), (F.sum(size).over(before) - size).cast("long").alias("start"))
    pairs = texts.join(places, part)
    mine = lambda x: x["role"] == F.col("speaker")
    head = lambda x: F.when(mine(x), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), x["role"], F.lit(END)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("spans"))

    def step(a, x):
        begin = a["at"] + F.length(head(x))
        end = begin + F.length(x["text"])
        span = F.when(mine(x), F.array(F.concat_ws("-", begin, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(a["out"], F.array(F.concat(head(x), x["text"], F.lit("\n")))).alias("out"), F.concat(a["spans"], span).alias("spans"))

    drawn = pairs.withColumn("_r", F.aggregate("turns", empty, step)).withColumn("n_turns", F.size("turns").cast("long"))
    return drawn.select(
        "conv_id",
        "speaker",
        "part",
        "start",
        "n_turns",
        F.size("_r.spans").cast("long").alias("n_spoken"),
        F.array_join("_r.out", "").alias("rendered"),
        F.array_join("_r.spans", ",").alias("mask"),
    )


ORACLE = f"""
with r as (select distinct conv_id, cast(turn as bigint) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
s as (select distinct conv_id, role as speaker from r),
x as (select r.conv_id, speaker, coalesce(floor(turn / {PART_TURNS}), -1) as chunk, turn, role, text,
  case when role = speaker then '<|assistant|>' || chr(10) else '<|user name=' || role || '|>' || chr(10) end as head
  from r join s on r.conv_id is not distinct from s.conv_id),
y as (select *, sum(length(head) + length(text) + 1) over (partition by conv_id, speaker, chunk order by turn nulls first, role, text) - length(text) - 1 as pos from x),
p as (select conv_id, speaker, chunk, count(*) as n_turns, count(*) filter (role = speaker) as n_spoken,
  string_agg(head || text || chr(10), '' order by turn nulls first, role, text) as rendered,
  coalesce(string_agg(cast(cast(pos as bigint) as varchar) || '-' || cast(cast(pos + length(text) as bigint) as varchar), ',' order by turn nulls first, role, text) filter (role = speaker), '') as mask
  from y group by all)
select conv_id, speaker, row_number() over w - 1 as part, cast(sum(length(rendered)) over w - length(rendered) as bigint) as start,
  n_turns, n_spoken, rendered, mask from p window w as (partition by conv_id, speaker order by chunk)"""
