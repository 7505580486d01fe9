"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bagminhash, decontam, grulm, langid, mixing, pii, prefs, repeats, resample, telephony, toxicity, warc, whiten
from tallyforge.llm.shared import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.headers_as_text(warc.resolve(warc.crawl(table(spark, sf_dir, "pages"))))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    return langid.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1, ["doc_id", "held_out"])


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefs.masks_as_text(prefs.format_pairs(prefs.echo_pairs(table(spark, sf_dir, "conversations"))))


def op8_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 7) == 2)
    return grulm.score(docs, fold("doc_id", 7) != 2, ["doc_id", "held_out"])


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digest(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.distinct(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op11_whitening: the exact deviations."""
    return op11_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6_pii: the number of base spans of each kind."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def audio_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9_telephony: the payload that is read back."""
    return op9_telephony(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_mixing: sizes and targets."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
PII_SQL = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents), f as (
  select doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as emails, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ips,
    regexp_extract_all(text, '[0-9]([ -]?[0-9])+') as cards, regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]') as phones from t
)
select doc_id, len(emails)::bigint as n_email,
  len(list_filter(ips, lambda m: len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(nullif(ltrim(x, '0'), '') as int), 0) > 255)) = 0))::bigint as n_ip,
  len(list_filter(cards, lambda m: length({_DIGITS}) between 13 and 19 and list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when i % 2 = 1 then cast(substr(reverse({_DIGITS}), i, 1) as int)
    else (2 * cast(substr(reverse({_DIGITS}), i, 1) as int)) // 10 + (2 * cast(substr(reverse({_DIGITS}), i, 1) as int)) % 10 end)) % 10 = 0))::bigint as n_card,
  len(list_filter(phones, lambda m: length({_DIGITS}) between 9 and 15))::bigint as n_phone
from f
"""
AUDIO_SQL = """
with t as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, '')))::bigint as n from documents), p as (
  select *, greatest(192, (n + 191) // 192 * 192)::bigint as size from t
)
select doc_id, n as n_bytes, size as payload_bytes, sha256(text || repeat(' ', size - n)) as payload_sha256 from p
"""
MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents), s as (
  select source, sum(size)::bigint as n, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from d group by source
), r as (select *, 2.0::double * n as cap, row_number() over (order by 2.0::double * n / w, source nulls last) as pos, sum(n) over () as total from s
), l as (select *, (1.5::double * total - coalesce(sum(cap) over (order by pos rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by pos rows between current row and unbounded following) as level from r
), f as (select *, (select level from l where level <= cap / w order by pos limit 1) as best from l)
select doc_id, size, n as source_size, round(least(cap, coalesce(best * w, cap)), 6) as target from d join f on d.source is not distinct from f.source
"""

#: Every window a row: for small tables.
REPEATS_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select *, length(h) // 2 as n_bytes from d),
w as (select r, i, md5(substr(h, 2 * i + 1, 800)) as m from (select r, h, unnest(range(0, n_bytes - 399)) as i from n where n_bytes >= 400)),
c as (select r, i, count(*) over (partition by m) as times from w),
g as (select r, i, sum(case when i - before > 400 or before is null then 1 else 0 end) over (partition by r order by i) as run from (select r, i, lag(i) over (partition by r order by i) as before from c where times > 1)),
s as (select r, run, min(i) as lo, max(i) + 400 as hi from g group by r, run),
b as (select *, coalesce(lag(hi) over (partition by r order by run), 0) as since from s),
k as (select r, run, substr(h, 2 * since + 1, 2 * (lo - since)) as part, hi, lo from n join b using (r)),
t as (select r, string_agg(part, '' order by run) as kept, max(hi) as last, sum(hi - lo)::bigint as n_removed, count(*) as n_spans from k group by r)
select doc_id, n_bytes::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(case when t.r is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256 from n left join t on n.r = t.r
"""
DEVIATION_SQL = """
with x as (select row_number() over () as r, vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint + 1000000) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c::double))) = 0),
c as (select r, vec_id, unnest(x) as v, generate_subscripts(x, 1) as i from x), s as (select i, sum(v) as s, count(*) as n from c group by i)
select any_value(vec_id) as vec_id, any_value(n)::bigint as n, sum((n * v - s) * (n * v - s))::bigint as deviation from c join s using (i) group by r
"""

_ALL = (op1_revisits, op2_decontamination, op3_language, op4_toxicity, op5_bagminhash, op6_pii, op7_preferences, op8_gru, op9_telephony, op10_mixing, op11_whitening, op12_suffixes, op13_resampling, pii_counts, audio_payloads, mix_targets, embedding_deviations)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op1_revisits": warc.ORACLE, "op7_preferences": prefs.ORACLE, "pii_counts": PII_SQL, "audio_payloads": AUDIO_SQL, "mix_targets": MIX_SQL, "embedding_deviations": DEVIATION_SQL, "op12_suffixes": REPEATS_SQL}
