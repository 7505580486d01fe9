"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions; DataFrame functions only.

The turns that both conversations begin with are rendered once, as the prompt; what is left of each is its
completion, with the spans of the assistant's words in it (code points, end exclusive), which alone take part in
the loss. A conversation is one row by nature: its prompt is one value.

Edge cases: a null role or text is an empty string; turns are ordered by (turn, role, text), null turns first, and
the same turn twice counts once; a conversation that a pair names but that isn't there has no turns; a pair of
equal conversations has two empty completions; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (turn, role, text)."""
    one = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


_RENDER = "array_join(transform({turns}, t -> concat('<|', t.role, '|>\\n', t.text, '<|end|>\\n')), '')"
_SPANS = """aggregate({turns}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)),
    (a, t) -> named_struct('at', a.at + length(t.role) + length(t.text) + 13,
        'out', if(t.role = 'assistant', array_append(a.out, named_struct('start', a.at + length(t.role) + 5, 'end', a.at + length(t.role) + 5 + length(t.text))), a.out)),
    a -> a.out)"""


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected (arrays of turns) to pair_id, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    empty = "cast(array() as array<struct<turn:bigint,role:string,text:string>>)"
    df = pairs.select("pair_id", F.expr(f"coalesce(chosen, {empty})").alias("a"), F.expr(f"coalesce(rejected, {empty})").alias("b"))
    n = "least(size(a), size(b))"
    alike = f"zip_with(slice(a, 1, {n}), slice(b, 1, {n}), (x, y) -> x.role = y.role and x.text = y.text)"
    df = df.withColumn("n_prefix", F.expr(f"cast(coalesce(nullif(array_position({alike}, false), 0) - 1, {n}) as int)"))
    df = df.select("pair_id", "n_prefix", F.expr("slice(a, 1, n_prefix)").alias("p"), F.expr("slice(a, n_prefix + 1, size(a))").alias("a"), F.expr("slice(b, n_prefix + 1, size(b))").alias("b"))
    return df.select(
        "pair_id", "n_prefix", F.expr(_RENDER.format(turns="p")).alias("prompt"),
        F.expr(_RENDER.format(turns="a")).alias("chosen"), F.expr(_SPANS.format(turns="a")).alias("chosen_mask"),
        F.expr(_RENDER.format(turns="b")).alias("rejected"), F.expr(_SPANS.format(turns="b")).alias("rejected_mask"),
    )


def join_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Preference rows of pairs (pair_id, chosen_id, rejected_id) of conversations of the table."""
    convs = gather(turns)
    got = pairs.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id", "left")
    got = got.join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected")), "rejected_id", "left")
    return format_pairs(got.select("pair_id", "chosen", "rejected"))


def echo_pairs(turns: DataFrame) -> DataFrame:
    """For a table without preferences: every conversation is chosen; rejected is its copy that ends at one of the assistant's
    turns (by the id, in turn) with an echo of the turn before it. Without such a turn the echo stands after all turns."""
    df = gather(turns)
    df = df.withColumn("places", F.expr("filter(transform(turns, (t, i) -> if(t.role = 'assistant' and i > 0, i, -1)), i -> i >= 0)"))
    df = df.withColumn("at", F.expr("coalesce(if(size(places) > 0, element_at(places, cast(pmod(coalesce(conv_id, 0), size(places)) as int) + 1), null), size(turns))"))
    reply = "array(named_struct('turn', cast(at as bigint), 'role', 'assistant', 'text', turns[at - 1].text))"
    return df.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.expr(f"concat(slice(turns, 1, at), {reply})").alias("rejected"))


def masks_as_text(rows: DataFrame) -> DataFrame:
    """Masks as start-end pairs joined by commas."""
    return rows.withColumns({c: F.expr(f"array_join(transform({c}, s -> concat(s.start, '-', s.end)), ',')") for c in ("chosen_mask", "rejected_mask")})


ORACLE = """
with t as (
  select distinct conv_id, cast(turn as bigint) turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
), n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i, count(*) over (partition by conv_id) as size from t
), places as (
  select conv_id, i, row_number() over (partition by conv_id order by i) - 1 as k, count(*) over (partition by conv_id) as m from n where role = 'assistant' and i > 0
), cut as (
  select c.conv_id, coalesce(p.i, c.size) as at from (select distinct conv_id, size from n) c
  left join places p on p.conv_id = c.conv_id and p.k = c.conv_id % p.m
), echo as (
  select n.conv_id, n.i + 1 as i, 'assistant' as role, n.text from n join cut on cut.conv_id = n.conv_id and n.i = cut.at - 1
), same as (
  select cut.conv_id, cut.at + case when n.role = e.role and n.text = e.text then 1 else 0 end as prefix
  from cut join echo e on e.conv_id = cut.conv_id left join n on n.conv_id = cut.conv_id and n.i = cut.at
), parts as (
  select n.conv_id, case when n.i < s.prefix then 'p' else 'a' end as part, n.i, n.role, n.text from n join same s on s.conv_id = n.conv_id
  union all
  select e.conv_id, 'b', e.i, e.role, e.text from echo e join same s on s.conv_id = e.conv_id where e.i >= s.prefix
), spread as (
  select *, coalesce(sum(length(role) + length(text) + 13) over (partition by conv_id, part order by i rows between unbounded preceding and 1 preceding), 0) + length(role) + 5 as start from parts
), made as (
  select conv_id, part, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by i) as body,
    string_agg(cast(start as bigint) || '-' || cast(start + length(text) as bigint), ',' order by i) filter (where role = 'assistant') as mask
  from spread group by conv_id, part
)
select s.conv_id as pair_id, cast(s.prefix as int) as n_prefix, coalesce(p.body, '') as prompt, coalesce(a.body, '') as chosen, coalesce(a.mask, '') as chosen_mask,
  coalesce(b.body, '') as rejected, coalesce(b.mask, '') as rejected_mask
from same s left join made p on p.conv_id = s.conv_id and p.part = 'p' left join made a on a.conv_id = s.conv_id and a.part = 'a' left join made b on b.conv_id = s.conv_id and b.part = 'b'
"""
