"""Multi-party perspective rotation of dialogues. DataFrame functions only.

For every participant of a conversation the dialogue is rendered once, with that speaker as assistant, the
others as named users and system messages as they are; the spans to learn from are the contents of the
assistant's messages.

A dialogue of any length is spread over many rows: ``part`` holds 64 turn numbers, and of a part ``cut``
counts pieces of ``CUT_MESSAGES`` messages, in the order of turn, hash of speaker and text, speaker, text.
Pieces in the order of part and cut give the whole. Every piece says how many messages the whole has
(``n_whole``) and whether it ends it (``last``); ``context`` is the conversation's first system message as
rendered, where the piece doesn't hold it itself.

Edge cases: a null text is an empty message; a null speaker is a participant of its own, a user without
name; the speaker ``system`` is the system role; line breaks, ``<``, ``>``, ``|`` and ``%`` in a speaker's name
are written as ``%`` and two hex digits, so different names stay different; messages without a turn come
first; repeated rows are repeated messages; the null conversation is one of its own; a conversation of
system messages only has no participant and no row; an empty table gives an empty result; other columns are
ignored; marks inside a text are broken up so that they can't be mistaken for the template's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stash, table
from ._ordered import cells_of, running_cells

PART_BITS = 6
CUT_MESSAGES = 128
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
FIRST_TURN = -(1 << 62)
ESCAPED = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("|", "%7C"), ("\r", "%0D"), ("\n", "%0A"))


def messages(conversations: DataFrame) -> DataFrame:
    """``(conv_id, part, at, h, speaker, content, n)``: distinct messages and how often each is repeated."""
    at = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN))
    speaker = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPED, F.col("role").cast("string"))
    content = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.shiftright(at, PART_BITS).alias("part"), at.alias("at"), speaker.alias("speaker"), content.alias("content"))
    rows = rows.withColumn("h", F.md5(F.concat(F.coalesce("speaker", F.lit("")), F.lit("\n"), F.col("content")).cast("binary")))
    return rows.groupBy("conv_id", "part", "at", "h", "speaker", "content").agg(F.count("*").alias("n"))


def placed(rows: DataFrame) -> DataFrame:
    """Add to written ``messages`` the place ``pos`` of the first copy in its part.

    Turns with many different messages are cut in cells by bits of the hash; cells are summed along the part.
    """
    most = rows.groupBy("conv_id", "at").count().agg(F.max("count")).first()[0] or 0
    bits = min(cells_of(most), 24)
    cell = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") if bits else F.lit(0).cast("long")
    turn = F.col("at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    rows = rows.withColumn("cell", F.shiftleft(turn, 24).bitwiseOR(F.shiftright(cell, 32 - bits) if bits else cell))
    cells = running_cells(rows.groupBy("conv_id", "part", "cell").agg(F.sum("n").alias("total")), ["conv_id", "part"], "cell", "total", PART_BITS + bits if bits else 0, "base")
    cells = cells.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("cell").alias("_cell"), "base")
    inside = Window.partitionBy("conv_id", "part", "cell").orderBy("h", F.asc_nulls_first("speaker"), "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("cell") == F.col("_cell"))
    return rows.join(cells, same).withColumn("pos", F.col("base") + F.col("ahead")).drop("_conv", "_part", "_cell", "base", "ahead", "cell")


def _header(speaker: Column, perspective: Column) -> Column:
    """The header of a message, as its perspective sees it."""
    role = (
        F.when(speaker == SYSTEM, F.lit("system"))
        .when(speaker.eqNullSafe(perspective), F.lit("assistant"))
        .when(speaker.isNull(), F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), speaker))
    )
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """``(conv_id, perspective, part, cut, last, n_whole, n_messages, n_trained, context, text, spans)``; spans
    are ``(start, end)`` in code points of the piece's text."""
    rows = placed(stash(messages(conversations), "chat-messages"))
    cuts = F.sequence(F.floor(F.col("pos") / CUT_MESSAGES), F.floor((F.col("pos") + F.col("n") - 1) / CUT_MESSAGES))
    rows = rows.withColumn("cut", F.explode(cuts))
    copies = F.least(F.col("pos") + F.col("n"), (F.col("cut") + 1) * CUT_MESSAGES) - F.greatest("pos", F.col("cut") * CUT_MESSAGES)
    rows = rows.withColumn("copies", copies.cast("int"))
    pieces = rows.groupBy("conv_id", "part", "cut").agg(F.array_sort(F.collect_list(F.struct("pos", "speaker", "content", "copies"))).alias("m"))
    pieces = pieces.withColumn("m", F.flatten(F.transform("m", lambda m: F.array_repeat(F.struct(m["speaker"].alias("speaker"), m["content"].alias("content")), m["copies"]))))
    piece = F.struct("part", "cut")
    first = F.min(F.when(F.col("speaker") == SYSTEM, F.struct("at", "h", "content", "part", "cut")))
    whole = rows.groupBy(F.col("conv_id").alias("_whole")).agg(F.sum("copies").alias("n_whole"), F.max(piece).alias("ends"), first.alias("system"))
    people = rows.where(F.col("speaker").isNull() | (F.col("speaker") != SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    people = people.join(whole, F.col("_conv").eqNullSafe(F.col("_whole")))
    seen = pieces.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    mine = F.col("perspective")
    text = F.array_join(F.transform("m", lambda m: F.concat(_header(m["speaker"], mine), m["content"], F.lit(CLOSE))), "")

    def step(a: Column, m: Column) -> Column:
        start = a["n"] + F.char_length(_header(m["speaker"], mine))
        end = start + F.char_length(m["content"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(CLOSE)).cast("int").alias("n"), F.when(m["speaker"].eqNullSafe(mine), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    seen = seen.withColumn("spans", F.aggregate("m", F.struct(F.lit(0).alias("n"), none.alias("spans")), step)["spans"])
    told = F.col("system").isNotNull() & (F.struct("system.part", "system.cut") != piece)
    context = F.when(told, F.concat(F.lit(f"{OPEN}{SYSTEM}\n"), F.col("system.content"), F.lit(CLOSE)))
    return seen.select(
        "conv_id", "perspective", "part", "cut", (F.col("ends") == piece).alias("last"), "n_whole", F.size("m").cast("long").alias("n_messages"),
        F.size("spans").cast("long").alias("n_trained"), context.alias("context"), text.alias("text"), "spans",
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each of its participants."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


ORACLE_SQL = """
with m as (
  select cast(conv_id as bigint) as conv_id, coalesce(cast(turn as bigint), -4611686018427387904) as turn_at,
         replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), '|', '%7C'), chr(13), '%0D'), chr(10), '%0A') as speaker,
         replace(coalesce(text, ''), '<|', '< |') as content
  from conversations
), h as (
  select *, turn_at >> 6 as part, md5(coalesce(speaker, '') || chr(10) || content) as h from m
), n as (
  select *, (row_number() over (partition by conv_id, part order by turn_at, h, speaker nulls first, content) - 1) as pos from h
), c as (
  select *, pos // 128 as cut from n
), whole as (
  select conv_id, count(*) as n_whole, max((part, cut)) as ends, min((turn_at, h, content, part, cut)) filter (where speaker = 'system') as sys from c group by conv_id
), people as (
  select distinct conv_id, speaker as perspective from m where speaker is null or speaker <> 'system'
), seen as (
  select c.*, perspective,
         '<|im_start|>' || case when speaker = 'system' then 'system' when speaker is not distinct from perspective then 'assistant'
                                when speaker is null then 'user' else 'user name=' || speaker end || chr(10) as head
  from c join people p on c.conv_id is not distinct from p.conv_id
), spans as (
  select *, coalesce(sum(length(head) + length(content) + 11) over (
              partition by conv_id, perspective, part, cut order by pos rows between unbounded preceding and 1 preceding), 0) + length(head) as s
  from seen
), done as (
  select conv_id, perspective, part, cut, count(*) as n_messages, count(*) filter (where speaker is not distinct from perspective) as n_trained,
         string_agg(head || content || '<|im_end|>' || chr(10), '' order by pos) as text,
         coalesce(string_agg(cast(s as bigint) || ':' || cast(s + length(content) as bigint), ',' order by s)
                  filter (where speaker is not distinct from perspective), '') as spans
  from spans group by conv_id, perspective, part, cut
)
select d.conv_id, perspective, cast(part as bigint) as part, cast(cut as bigint) as cut, ends = (part, cut) as last, n_whole, n_messages, n_trained,
       case when sys is not null and (sys[4] <> part or sys[5] <> cut) then '<|im_start|>system' || chr(10) || sys[3] || '<|im_end|>' || chr(10) end as context, text, spans
from done d join whole w on d.conv_id is not distinct from w.conv_id
"""
