"""Queries on streams, progress, graphs of jobs, clients, checked tables, nested reports and pairings by place."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallyforge.operators import graphs as G
from tallyforge.operators import joins as J
from tallyforge.operators import progress as R
from tallyforge.operators import scoring as C
from tallyforge.operators import selection as X
from tallyforge.plans import views as V
from tallyforge.plans.registry import query
from tallyforge.sources import sinks
from tallyforge.sources.scratch import scratch
from tallyforge.streaming import incremental as I


@query("strm01_append_once", "select event_id, ts, user_id, event_type, value from events")
def append_once(spark, sf):
    """Events that come in overlapping deliveries: each slice of time twice, and one delivery again, the stream stopped and taken up in between."""
    events = V.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = ((high or 0) - (low or 0)) // 6 + 1
    inbox, out, log = scratch(spark, "inbox"), scratch(spark, "appended"), scratch(spark, "appended-log")
    slice_ = F.floor((F.unix_micros("ts") - F.lit(low or 0)) / width)

    def deliver(*numbers: int) -> None:
        for k in numbers:
            events.filter(slice_.isin(k - 1, k)).write.mode("append").parquet(inbox)

    def run() -> None:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(inbox)
        I.append_once(stream, out, log, ["event_id"], "ts", f"{width * 5 // 2_000_000 + 1} seconds").awaitTermination()

    deliver(0, 1, 2)
    run()
    deliver(3, 1, 4, 5)
    run()
    return I.appended(spark, out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _progress_sql(by: str, items: int, seconds: int) -> str:
    keys = by.split(", ")
    same = lambda x, y: " and ".join(f"{x}.{k} = {y}.{k}" for k in keys)
    return f"""with recursive n as (select {by}, ts, row_number() over (partition by {by} order by ts, event_id) as i, count(*) over (partition by {by}) as total, min(ts) over (partition by {by}) as began from events),
      e as (select distinct {by}, 0::bigint as i, began as ts from n
        union all select {', '.join(f'x.{k}' for k in keys)}, x.i, x.ts from (select n.*, row_number() over (partition by {', '.join(f'n.{k}' for k in keys)} order by n.i) as first from e join n on {same('e', 'n')} and n.i > e.i and n.i <= e.i + {items}
          where n.i = e.i + {items} or n.i = n.total or epoch_us(n.ts) - epoch_us(e.ts)  >= {seconds * 1_000_000}::bigint) x where x.first = 1)
    select {', '.join(f'n.{k}' for k in keys)}, n.i as completed, n.total, (epoch_us(n.ts) - epoch_us(n.began)) / 1e6::double as elapsed from e join n on {same('e', 'n')} and e.i = n.i"""


@query("win14_progress", _progress_sql("user_id, event_type", 4, 6 * 86_400))
def progress(spark, sf):
    return R.progress(V.table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id", 4, 6 * 86_400)


@query("win14_progress_of_types", _progress_sql("event_type", 10, 3 * 3600))
def progress_of_types(spark, sf):
    """Long runs, cut into chunks."""
    return R.progress(V.table(spark, sf, "events"), ["event_type"], "ts", "event_id", 10, 3 * 3600, chunk=256)


_JOBS = "j as (select p_partkey as job, case when p_partkey % 211 = 0 then 'other' else ['data', 'experiment', 'figures'][1 + p_partkey % 3] end as phase, (p_partkey % 53)::int as units from part where p_partkey > 0)"
_DEPS = """d as (select job, job // 2 as dep from j where job // 2 > 0 union select job, job // 3 from j where job // 3 > 0 union select job, 2 * job from j where job % 97 = 0 and 2 * job <= (select max(job) from j))"""


def _jobs(spark, sf):
    """Parts as jobs: each depends on its half and its third; some, in a cycle, on their double."""
    job = F.col("p_partkey").cast("long")
    phase = F.when(job % 211 == 0, "other").otherwise(F.get(F.array(F.lit("data"), F.lit("experiment"), F.lit("figures")), (job % 3).cast("int")))
    jobs = V.table(spark, sf, "part").filter(job > 0).select(job.alias("job"), phase.alias("phase"), (job % 53).cast("int").alias("units"))
    top = jobs.agg(F.max("job")).first()[0] or 0
    of = F.explode(F.array(F.floor(F.col("job") / 2), F.floor(F.col("job") / 3), F.when((F.col("job") % 97 == 0) & (F.col("job") * 2 <= top), F.col("job") * 2)))
    deps = jobs.select("job", of.alias("dep")).filter("dep > 0").distinct()
    return jobs, deps


@query("pres06_levels", f"""with recursive {_JOBS}, {_DEPS}, up as (select job, 0 as level from j where job not in (select job from d) union select d.job, up.level + 1 from up join d on d.dep = up.job where up.level < 60)
    select job, case when max(level) < 50 then max(level) end as level from up group by job""")
def job_levels(spark, sf):
    return G.levels(*_jobs(spark, sf))


@query("pres06_selection", f"""with {_JOBS}, {_DEPS}, w as (select job from j where phase = 'experiment')
    select 'selected' as kind, job, null::bigint as dep from w union all select 'dependency', job, dep from d where job in (from w) and dep in (from w)
    union all select distinct 'before', dep, null from d where job in (from w) and dep not in (from w)""")
def job_selection(spark, sf):
    jobs, deps = _jobs(spark, sf)
    chosen, inner, before = G.selection(jobs, deps, F.col("phase") == "experiment")
    none = F.lit(None).cast("long").alias("dep")
    return chosen.select(F.lit("selected").alias("kind"), "job", none).unionByName(inner.select(F.lit("dependency").alias("kind"), "job", "dep")).unionByName(before.select(F.lit("before").alias("kind"), "job", none))


@query("pres06_faults", f"""with {_JOBS}, {_DEPS}, twice as (select * from j union all select * from j where job % 101 = 0), more as (select * from d union all select job, job + 1000000000 from j where job % 89 = 0)
    select job, 'duplicate id' as fault, count(*)::varchar as detail from twice group by job having count(*) > 1 union all select job, 'unknown phase', phase from twice where phase = 'other' union all select job, 'no units', units::varchar from twice where units <= 0
    union all select job, 'unknown dependency', dep::varchar from more where dep not in (select job from j)""")
def job_faults(spark, sf):
    jobs, deps = _jobs(spark, sf)
    twice = jobs.unionByName(jobs.filter("job % 101 = 0"))
    return G.faults(twice, deps.unionByName(jobs.filter("job % 89 = 0").select("job", (F.col("job") + 1_000_000_000).alias("dep"))), ["data", "experiment", "figures"])


class LocalClient:
    """A client whose losses and failures are fixed by the prompts (label|template|id): as a remote one, but the same on each run."""

    @staticmethod
    def draw(salt: str, text: str, n: int) -> int:
        return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest(), 16) % n

    def loss(self, prompt: str) -> float:
        if not self.draw("u", prompt, 50):
            raise TimeoutError(prompt)
        return 5 + self.draw("c", prompt, 10_000) / 2500


class TieredClient(LocalClient):
    """One that takes several prompts at a time, and fails as a whole."""

    #: tier: (salt of its failures, one in so many, whether a problem, not a prompt, makes it fail)
    FAILS = {"batch": ("f", 40, True), "corrected": ("g", 100, True), "item": ("h", 3, True), "template": ("t", 4, False)}

    def losses(self, prompts: list[str], tier: str) -> list[float]:
        salt, n, of_problem = self.FAILS[tier]
        if any(not self.draw(salt, p.rsplit("|", 1)[1] if of_problem else p, n) for p in prompts):
            raise ConnectionError(tier)
        return [5 + self.draw("c", p, 10_000) / 2500 for p in prompts]


def _prompts(spark, sf):
    """A prompt for each template of each label of a problem, in batches of 30 problems."""
    p = V.problems(spark, sf).select("id", F.floor(F.col("k") / 30).alias("batch"), F.explode(F.array(*(F.lit(x) for x in V.LABELS))).alias("label")).withColumn("template", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return p.withColumn("prompt", F.concat_ws("|", "label", F.col("template").cast("string"), "id"))


_PROMPTS = f"{V.PROBLEMS}, x as (select id, k // 30 as batch, label, template, label || '|' || template || '|' || id as prompt from problems, (select unnest(['DD', 'OT', 'RC']) as label), (select unnest([0, 1]) as template))"
_LOSS = f"(5 + {V.s_draw('c', 'prompt')} / 2500::double)"


@query("udf02_losses", f"with {_PROMPTS} select id, label, template, case when {V.s_draw('u', 'prompt', 50)} = 0 then 'inf'::double else {_LOSS} end as loss from x")
def losses(spark, sf):
    return C.score(_prompts(spark, sf), LocalClient).select("id", "label", "template", "loss")


@query("agg18_cascade", f"""with {_PROMPTS}, y as (select *, bool_or({V.s_draw('f', 'id', 40)} = 0) over (partition by batch) as f, bool_or({V.s_draw('g', 'id', 100)} = 0) over (partition by batch) as g, {V.s_draw('h', 'id', 3)} = 0 as h, {V.s_draw('t', 'prompt', 4)} = 0 as t, {_LOSS} as loss from x),
    z as (select id, label, case when not f then 'batch' when not g then 'corrected' when not h then 'item' when not t then 'template' end as tier, loss from y)
    select id, label, count(tier) as n_finite, coalesce(avg(loss) filter (where tier is not null), 'inf'::double) as loss, min(tier) as tier from z group by id, label""")
def tiered_losses(spark, sf):
    """A batch of problems at a time, once more if that fails, then a problem, then a prompt at a time; the mean of what is finite."""
    tiers = [("batch", ["batch"]), ("corrected", ["batch"]), ("item", ["id"]), ("template", ["id", "label", "template"])]
    rows = C.cascade(_prompts(spark, sf), TieredClient, tiers)
    return C.mean_finite(rows, ["id", "label"]).join(rows.groupBy("id", "label").agg(F.min("tier").alias("tier")), ["id", "label"])


@query("src20_checked_scan", f"""with {V.PROBLEMS}, t as (select band, count(*) as n from problems where split = 'test' group by band), a as (select band, count(*) as n from problems group by band)
    select 'first' as request, 1 as version, band, n from t union all select 'again', 1, band, n from t union all select 'other', 2, band, n from a""")
def checked_scan(spark, sf):
    """A stored table asked for twice, then with other quotas: made, used again, made anew as the next version."""
    all_ = V.problems(spark, sf).select("id", "complexity_c", "split", "band")
    test, root = all_.filter("split = 'test'"), scratch(spark, "checked")

    def asked(name, rows):
        quotas = {r[0]: r["n"] for r in rows.groupBy("complexity_c").agg(F.count("*").alias("n")).collect()}
        table, version = sinks.checked(spark, root, lambda: rows, lambda df: sinks.matches(df, quotas))
        return table.groupBy("band").agg(F.count("*").alias("n")).select(F.lit(name).alias("request"), F.lit(version).alias("version"), "band", "n")

    return asked("first", test).unionByName(asked("again", test)).unionByName(asked("other", all_))


_STEP = "coalesce({0}::varchar, 'null') || '->' || coalesce({1}::varchar, 'null')"


@query("snk02_analysis", f"""with {V.VARIANTS}, s as (select lora, design_family, 'detection' as name, {_STEP.format('base_detected', 'lora_detected')} as step from variants union all select lora, design_family, 'correctness', {_STEP.format('base_correct', 'lora_correct')} from variants)
    select lora, case when grouping(design_family) = 1 then 'all' else design_family end as target, name, step, count(*) as n from s group by grouping sets ((lora, design_family, name, step), (lora, name, step))""")
def analysis_json(spark, sf):
    """The nested report of each adapter, written as JSON and read back."""
    path = scratch(spark, "analysis")
    pairs = {"detection": ("base_detected", "lora_detected"), "correctness": ("base_correct", "lora_correct")}
    sinks.analysis(V.variants(spark, sf), "lora", pairs, "design_family").write.json(path)
    out = spark.read.schema(f"lora string, analysis {sinks.ANALYSIS}").json(path)
    return out.select("lora", F.explode("analysis").alias("target", "x")).select("lora", "target", F.explode("x").alias("name", "y")).select("lora", "target", "name", F.explode("y").alias("step", "n"))


@query("join06_zip", f"""with {V.VARIANTS}, l as (select id, base_answer, row_number() over (order by id) as place from variants where lora = 'DD'), r as (select id, lora_answer, row_number() over (order by id) as place from variants where lora = 'OT' and k % 3 <> 0)
    select place, l.id as id_1, base_answer as answer_1, r.id as id_2, lora_answer as answer_2 from l join r using (place)""")
def zipped(spark, sf):
    """Answers paired by their places in two lists, as far as the shorter one goes."""
    v = V.variants(spark, sf)
    left = v.filter("lora = 'DD'").select(F.col("id").alias("key"), "id", F.col("base_answer").alias("answer"))
    right = v.filter("lora = 'OT' and k % 3 <> 0").select(F.col("id").alias("key"), "id", F.col("lora_answer").alias("answer"))
    return J.zipped(left, right, ["key"])


@query("join08_images", f"""with {V.VARIANTS}, i as (select id, lora_detected as detected, lora_answer as answer, row_number() over (partition by id order by lora desc) as rn from variants where k % 4 <> 0 and lora in ('DD', 'OT')),
    t as (select distinct id, base_detected from variants) select t.id, t.base_detected, i.detected as image_detected, i.answer as image_answer from t left join i on t.id = i.id and i.rn = 1""")
def images(spark, sf):
    v = V.variants(spark, sf)
    image = v.filter("k % 4 <> 0 and lora in ('DD', 'OT')").select("id", F.col("lora_detected").alias("detected"), F.col("lora_answer").alias("answer"), F.col("lora").alias("ord"))
    return J.with_images(v.filter("lora = 'DD'").select("id", "base_detected"), image, ["detected", "answer"])


_MIX = {2: 0.2, 3: 0.3, 5: 0.25, 12: 0.25}
_LENGTH = "length(cast(a as varchar))"


@query("win04_length_balanced", f"""with {V.PROBLEMS}, m as (select * from (values {', '.join(f'({k}, {v}::double)' for k, v in _MIX.items())}) t(len, share)), n as (select count(*) * 3 // 10 as total from problems),
    c as (select len, share * total as ideal, total, (select count(*) from problems where {_LENGTH} = len) as have from m, n), q as (select *, least(round_even(ideal, 0), have)::bigint as first from c),
    g as (select *, total - sum(first) over () as gap, have > first as open from q), o as (select *, row_number() over (partition by open order by ideal - floor(ideal) desc, len) as pos, count(*) filter (where open) over () as n_open from g),
    w as (select len, first + case when open then gap // n_open + (pos <= gap % n_open)::int else 0 end as quota from o),
    p as (select id, {_LENGTH} as len, row_number() over (partition by {_LENGTH} order by {V.s_bucket("('q:' || id)", 1_000_003)}, id) as rank from problems)
    select id, len, rank from p join w using (len) where rank <= quota""")
def length_balanced(spark, sf):
    """Three tenths of the problems by a mix of lengths, one of which has none: the others fill its share."""
    p = V.problems(spark, sf).select("id", F.length(F.col("a").cast("string")).alias("len"))
    return X.length_balanced(p, p.count() * 3 // 10, _MIX, "len").select("id", F.col("len").cast("long").alias("len"), F.col("rank").cast("long").alias("rank"))
