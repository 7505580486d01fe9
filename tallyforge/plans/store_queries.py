"""Queries on sets that are enumerated, factors of experts, files of assets, and the ways in which problem files are read."""

from __future__ import annotations

import io

from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.operators import enumerated as E
from tallyforge.operators import generation as G
from tallyforge.operators import similarity as M
from tallyforge.plans import digit_queries as DQ
from tallyforge.plans import views as V
from tallyforge.plans.registry import query
from tallyforge.sources import assets, readers, sinks
from tallyforge.sources.scratch import scratch

_LAST, _MULTIPLES, _FAR = E.last_digit(4, 10, 999_999, 7), E.multiples(5, 10, 999_999, 25), E.far_from_bases(3, 10, 999_999, D.scaled_bases(), 2)
_NEAR3 = "list_sort(list_transform([" + ", ".join(f"{{'d': abs(n - {x}), 'i': {i}, 's': {D._scale(x)}}}" for i, x in enumerate(D.scaled_bases())) + "], lambda t: {'d': t.d, 'i': t.i, 's': t.s}))[1]"


@query("gen08_members", f"""with {V.PROBLEMS}, far as (select n, row_number() over (order by n) - 1 as k from (select unnest(range(100, 1000)) as n) where n % 5 <> 0 and {_NEAR3}.d / {_NEAR3}.s::double > 2), c as (select count(*) as size from far)
    select id, 1007 + 10 * {V.s_draw('l', 'id', _LAST.size)}::bigint as last_digit, 10000 + 25 * {V.s_draw('m', 'id', _MULTIPLES.size)}::bigint as multiple, far.n as far from problems, c join far on far.k = {V.s_bucket("('f:' || id)", _FAR.size)}""")
def members(spark, sf):
    """A member of each constrained set for each problem."""
    at = lambda salt, m: m.member(V.draw(salt, F.col("id"), m.size).cast("bigint"))
    return V.problems(spark, sf).select("id", at("l", _LAST).alias("last_digit"), at("m", _MULTIPLES).alias("multiple"), at("f", _FAR).alias("far"))


_POOL = [b for b in D.scaled_bases() if b <= 5000]
_NEAR = " union all ".join(f"select {b} as base, unnest({sorted({b + s * x for x in D.near_offsets(b, 2) for s in (1, -1) if b + s * x >= 10})}) as v" for b in _POOL)


@query("gen10_pool", f"""with {V.PROBLEMS}, near as ({_NEAR}), q as (select distinct x.v as a, y.v as b from near x join near y on x.base = y.base and x.v <= y.v), c as (select a, b, {DQ._OT} as ot, {DQ._DD} as dd, {DQ._RC} as rc from q
      where not exists (select 1 from problems p where least(p.a, p.b) = q.a and greatest(p.a, p.b) = q.b))
    select a::bigint as a, b::bigint as b from c where rc <= least(ot, dd) - 0.75""")
def pool(spark, sf):
    """Pairs near one base that aren't problems yet and that rounding is cheapest for."""
    new = G.scored(E.fresh(E.near_base_pairs(spark, _POOL), V.problems(spark, sf)))
    return new.filter("canonical_target_heuristic = 'RC'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_EXPERTS = """ad as (select vec_id % 4 as n, (vec_id // 4) % 3 as expert, vec_id // 12 as g, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as key from embeddings),
    fa as (select 'e' || n as name, expert, key % 4 as r, g * 8 + key // 4 as i, value from ad where key < 32 and (n > 0 or expert = 0)), fb as (select 'e' || n as name, expert, g * 8 + (key - 32) // 4 as o, (key - 32) % 4 as r, value from ad where key >= 32 and (n > 1 or expert = 0)),
    xa as (select name, e.expert, r, i, value from fa join (select unnest([0, 1, 2]) as expert) e on e.expert = fa.expert or name = 'e0'), xb as (select name, e.expert, o, r, value from fb join (select unnest([0, 1, 2]) as expert) e on e.expert = fb.expert or name in ('e0', 'e1')),
    up as (select xb.name, xb.expert, o, i, sum(xb.value * xa.value) as w from xb join xa on xa.name = xb.name and xa.r = xb.r and xa.expert = xb.expert group by 1, 2, 3, 4)"""


@query("stat11_experts", f"with {_EXPERTS} select x.name as name_1, y.name as name_2, round(sum(x.w * y.w), 4) as inner_product from up x join up y on x.o = y.o and x.i = y.i and x.expert = y.expert and x.name <= y.name where not (x.name = 'e0' and y.name = 'e0' and x.expert > 0) group by 1, 2")
def experts(spark, sf):
    """Four adapters of three experts; the first has one for both factors, the second one for B."""
    ad = V.table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("n"), (F.floor(F.col("vec_id") / 4) % 3).alias("expert"), F.floor(F.col("vec_id") / 12).alias("g"), F.posexplode("embedding").alias("key", "x")).withColumns({"value": F.col("x").cast("double"), "name": F.concat(F.lit("e"), "n")})
    a = ad.filter("key < 32 and (n > 0 or expert = 0)").select("name", "expert", (F.col("key") % 4).alias("r"), (F.col("g") * 8 + F.floor(F.col("key") / 4)).alias("i"), "value")
    b = ad.filter("key >= 32 and (n > 1 or expert = 0)").select("name", "expert", (F.col("g") * 8 + F.floor((F.col("key") - 32) / 4)).alias("o"), (F.col("key") % 4).alias("r"), "value")
    return M.update_inner_of_experts(a, b).select("name_1", "name_2", F.round("inner", 4).alias("inner_product"))


_TEXT = "(a || ' × ' || b)"


@query("gen14_assets", f"""with {V.PROBLEMS} select id || '.svg' as name, md5('<svg xmlns="http://www.w3.org/2000/svg" width="' || (20 + 14 * length({_TEXT})) || '" height="40"><text x="10" y="27" font-size="24">' || {_TEXT} || '</text></svg>') as md5 from problems where split = 'test'""")
def pictures(spark, sf):
    """Pictures of the test problems, written as files and read back."""
    path = scratch(spark, "pictures")
    rows = V.problems(spark, sf).filter("split = 'test'").select(F.concat("id", F.lit(".svg")).alias("file"), "a", "b")
    assets.write_assets(rows, path, assets.svg, "file", ["a", "b"])
    return assets.read_assets(spark, path, "*.svg").select("name", F.md5("content").alias("md5"))


def _npz(row) -> bytes:
    import numpy as np

    out = io.BytesIO()
    values = np.array(row.values_, np.float32)
    np.savez(out, **{"lora_A": values[:32].reshape(4, 8), "lora_B": values[32:].reshape(2, 2, -1)})
    return out.getvalue()


@query("src18_tensors", """select 'v' || vec_id as name, case when i <= 32 then 'lora_A' else 'lora_B' end as key, case when i <= 32 then 0 else (i - 33) // 16 end::int as expert, case when i <= 32 then (i - 1) // 8 else ((i - 33) // 8) % 2 end::int as row, ((i - 1) % 8)::int as col, x::double as value
    from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings)""")
def tensors(spark, sf):
    """Vectors written as .npz files of two factors, and read as rows."""
    path = scratch(spark, "tensors")
    rows = V.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id", F.lit(".npz")).alias("file"), F.col("embedding").alias("values_"))
    assets.write_assets(rows.coalesce(16), path, _npz, "file", ["values_"])
    return readers.read_tensors(spark, f"{path}/part-*")


@query("src19_alignment", """with s as (select 'v' || vec_id as name, case when vec_id % 5 = 0 then 3 else 4 end as r, vec_id from embeddings where vec_id < 60), k as (select name, unnest(case when vec_id % 7 = 3 then ['A'] else ['A', 'B'] end) as key, r from s)
    select n.name, w.key, w.r as want, k.r as have from (select distinct name from k) n cross join (select key, r from k where name = 'v1') w left join k on k.name = n.name and k.key = w.key where k.r is null or k.r <> w.r""")
def alignment(spark, sf):
    """Adapters whose arrays aren't those of the first one, in keys or shapes."""
    v = V.table(spark, sf, "embeddings").filter("vec_id < 60").select("vec_id", F.concat(F.lit("v"), "vec_id").alias("name"), F.when(F.col("vec_id") % 5 == 0, 3).otherwise(4).alias("r"))
    keys = F.when(F.col("vec_id") % 7 == 3, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    cells = v.select("name", F.explode(keys).alias("key"), "r").select("name", "key", F.lit(0).alias("expert"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("value"))
    return readers.shape_mismatches(cells, "v1").select("name", "key", F.col("want.r").alias("want"), F.col("have.r").alias("have"))


def _problem_file(spark, sf, one_split: bool = False):
    """Problems as a CSV file: a target besides the family, no split for every fifth."""
    path = scratch(spark, "problems")
    p = V.problems(spark, sf)
    split = F.when(F.col("k") % 5 != 0, F.col("split"))
    sinks.write_csv(p.select("id", "a", "b", "product", "design_family", F.when(F.col("k") % 3 != 0, F.col("canonical_target")).alias("canonical_target_heuristic"), split.alias("split")), path)
    return readers.read_csv(spark, path)


@query("src04_canonical_first", f"with {V.PROBLEMS} select id, case when k % 3 <> 0 then canonical_target else design_family end as target_heuristic, complexity_c::double as complexity_c from problems")
def canonical_first(spark, sf):
    """The cheapest method names the target, the family where there is none."""
    return readers.problems(_problem_file(spark, sf), prefer="canonical").select("id", "target_heuristic", "complexity_c")


@query("src05_06_splits", f"""with {V.PROBLEMS}, f as (select *, case when k % 5 <> 0 then split end as said from problems) select 'strict' as how, design_family, count(*) as n from f where said = 'val' group by 2
    union all select 'lenient', design_family, count(*) from f where said = 'val' or said is null group by 2 union all select 'no column', design_family, count(*) from f group by 2""")
def splits(spark, sf):
    """A split by exact value; with rows that have none; of a table that has no such column."""
    f = _problem_file(spark, sf)
    count = lambda how, df: df.groupBy("design_family").agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "design_family", "n")
    return count("strict", readers.of_split(f, "val")).unionByName(count("lenient", readers.of_split(f, "val", lenient=True))).unionByName(count("no column", readers.of_split(f.drop("split"), "val", lenient=True)))


@query("src13_15_analysis", f"""with {V.PROBLEMS}, n as (select design_family, count(*) as n from problems where k % 2 = 0 group by 1) select 'cosine_similarity' as format, design_family as family, n from n""")
def resolved_analysis(spark, sf):
    """The best of the similarity files that are there: of two formats, the one before."""
    root = scratch(spark, "root")
    counts = V.problems(spark, sf).filter("k % 2 = 0").groupBy("design_family").agg(F.count("*").alias("n"))
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct("design_family", "n"))).alias("families"))
    for name in ("cosine_similarity.json", "gradient_analysis.json"):
        whole.coalesce(1).write.json(f"{root}/gradient_analysis_30b/{name}")
    found = readers.similarities(spark, root, "30b", "families map<string, bigint>")
    return found.select("format", F.explode("families").alias("family", "n"))


@query("snk07_09_cache", f"with {V.PROBLEMS} select split, count(*) as n, 1::bigint as made from problems group by split")
def cache(spark, sf):
    """A table stored by the key of its input and asked for twice, made once; the number of makings comes back from the manifest."""
    root, made = scratch(spark, "cache"), []
    p = V.problems(spark, sf).select("id", "split")
    key = sinks.content_key(p, {"what": "splits"})

    def make():
        made.append(key)
        return p.groupBy("split").agg(F.count("*").alias("n"))

    for _ in range(2):
        out = sinks.cached(spark, root, key, make)
    sinks.write_manifest(spark, f"{root}/manifest", {"key": key, "made": len(made)})
    return out.join(F.broadcast(spark.read.schema("made bigint").json(f"{root}/manifest")))
