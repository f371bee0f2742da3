"""Chat formatting by perspective rotation.

A conversation is rendered once for every participant: that speaker's turns are
the assistant's, all others are named users, and the loss mask covers what the
speaker says, with the end of the turn. Turns of a narrator (the system role) are
system turns in every rendering and nobody's perspective.

A rendering comes in parts of 64 turns, each with its place in the whole. Parts
are dealt by conversation and salt, and places come from lengths alone, summed by
blocks of parts, so a conversation of any length is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NARRATORS = ("system",)
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers that share all bits but the last six make a part.
PART_BITS = 6
#: Parts that share all bits but the last so many are a block; parts are dealt by so many salts.
BLOCK_BITS, SALTS = 10, 16
#: Unnumbered turns stand in so many parts, by a hash, before all others.
UNNUMBERED = -(1 << 34)
NOBODY = "unknown"


def _told(speaker: Column, role: Column, narrators: tuple) -> Column:
    return F.when(role.isin(*narrators), F.lit("system")).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", narrators: tuple = NARRATORS) -> DataFrame:
    """(conv, speaker, part, start, rendered, spans): one row for each perspective and part.

    ``start`` is the part's first character in the whole rendering, ``spans`` the
    trained ranges [a, b) in it. A null text is empty, a null role is ``unknown``.
    Turns without a number come first, in parts by the first 16 bits of the MD5 of
    role and text. Turns of one number (or part, without one) stand in order of
    role and text; repeated rows are repeated turns. Rows with a null conversation
    are left out. Control marks inside a text are broken up with a space. A
    conversation of narrators alone has no rendering; an empty table gives none.
    Other columns are not read.
    """
    safe = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |")
    told_role = F.coalesce(F.col(role), F.lit(NOBODY))
    unnumbered = F.lit(UNNUMBERED) + F.conv(F.substring(F.md5(F.concat_ws(":", told_role, safe)), 1, 4), 16, 10).cast("long")
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.coalesce(F.shiftright(F.col(turn).cast("long"), PART_BITS), unnumbered).alias("part"), F.struct(F.coalesce(F.col(turn), F.lit(-1)).cast("long").alias("turn"), told_role.alias("role"), safe.alias("text")).alias("t"))
    speakers = own.select("conv", F.col("t.role").alias("speaker")).where(~F.col("speaker").isin(*narrators)).distinct()
    parts = own.groupBy("conv", "part").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn("salt", F.pmod("part", F.lit(SALTS)))
    each = parts.join(speakers.withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS))))), ["conv", "salt"])

    def turn_of(t: Column) -> Column:
        head = F.concat(F.lit(BEGIN), _told(F.col("speaker"), t["role"], narrators), F.lit("\n"))
        return F.struct(F.length(head).cast("long").alias("head"), F.concat(head, t["text"], F.lit(END + "\n")).alias("all"), (t["role"] == F.col("speaker")).alias("own"))

    told = each.select("conv", "speaker", "part", F.transform("turns", turn_of).alias("told"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        end = s["at"] + F.length(t["all"])
        span = F.array(F.struct((s["at"] + t["head"]).alias("a"), (end - 1).alias("b")))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    done = told.select("conv", "speaker", "part", F.array_join(F.col("told.all"), "").alias("rendered"), F.aggregate("told", empty, add).alias("s"))
    keys = ["conv", "speaker", "part"]
    block = F.shiftright("part", BLOCK_BITS)
    sizes = done.select(*keys, block.alias("block"), F.col("s.at").alias("n"))
    earlier = Window.partitionBy("conv", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("conv", "speaker", "block").agg(F.sum("n").alias("n")).select("conv", "speaker", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv", "speaker", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["conv", "speaker", "block"]).select(*keys, (F.col("base") + F.col("ahead")).cast("long").alias("start"))
    placed = done.join(starts, keys)
    return placed.select("conv", "speaker", "part", "start", "rendered", F.transform("s.spans", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b"))).alias("spans"))


def op1_chat_formatting(turns: DataFrame) -> DataFrame:
    """Digest of all renderings: their parts, lengths and masks."""
    out = rotate_perspectives(turns)
    return out.select(F.col("conv").alias("conv_id"), "speaker", F.col("part").cast("long").alias("part"), "start", F.length("rendered").cast("long").alias("n_chars"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]).alias("n_trained"), F.sha2("rendered", 256).alias("rendered_sha256"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ",").alias("spans"))


OP1_SQL = r"""
with t as (select conv_id, coalesce(turn >> 6, -17179869184 + ('0x' || substr(md5(role || ':' || text), 1, 4))::bigint) as part, coalesce(turn, -1) as turn, role, text from (select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations where conv_id is not null)),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
h as (select t.*, speaker, role = speaker as own, '<|im_start|>' || case when role = 'system' then 'system' when role = speaker then 'assistant' else 'user name=' || role end || chr(10) as head from t join s using (conv_id)),
r as (select *, head || text || '<|im_end|>' || chr(10) as told from h),
p as (select *, coalesce(sum(length(told)) over (partition by conv_id, speaker order by part, turn, role, text rows between unbounded preceding and 1 preceding), 0) as pos from r)
select conv_id, speaker, part::bigint as part, min(pos)::bigint as start, sum(length(told))::bigint as n_chars, sum(case when own then length(told) - length(head) - 1 else 0 end)::bigint as n_trained,
  sha256(string_agg(told, '' order by turn, role, text)) as rendered_sha256, coalesce(string_agg((pos + length(head))::bigint || ':' || (pos + length(told) - 1)::bigint, ',' order by turn, role, text) filter (where own), '') as spans
from p group by 1, 2, 3
"""
