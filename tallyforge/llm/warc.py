"""Not-modified revisits of web archives, resolved to the latest earlier full response of the same canonical URL.

An as-of join in two levels, as one URL may hold a third of all records: records are dealt by (URL, slice of
time); within a slice a running maximum finds the latest earlier response, and what a slice doesn't hold comes
from the last response of the URL's earlier slices, of which there is one row each. Slices are quantiles of all records'
times, so none holds many more than others, whatever the span. A time that is itself a quantile twice (or null) is a slice of its
own and is dealt further: its records, being of one time, find nothing among themselves.

A revisit is resolved if a validator agrees: its ETag (weak comparison) if both have one, else its Last-Modified,
else the payload digest. Headers of the 304 replace those of the response, but for those that describe a body or a
connection (RFC 9111, 3.2); other headers of the response stay.

Edge cases: null URLs form one group of their own; a null time sorts before all, so such a response is earlier than
any dated revisit; a response of the same time isn't earlier; of responses of one time the largest id counts;
repeated rows give repeated results; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES, SALTS = 256, 64
#: Headers that a 304 doesn't change in the stored response.
KEPT_BACK = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$"
_LONG_AGO = -(1 << 62)


def canonical(url: Column) -> Column:
    """Without scheme, credentials, www or m host, default port, fragment, tracking parameters and a last slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged(stored: Column, fresh: Column) -> Column:
    """Arrays of (name, value), names in lower case: stored ones without what fresh replaces, then fresh ones that may, sorted."""
    may = F.filter(fresh, lambda h: ~h["name"].isin(*KEPT_BACK))
    names = F.transform(may, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), may))


def _slice(df: DataFrame, slices: int) -> Column:
    """Even numbers for times that are slices of their own, odd ones for those between; -2 for null."""
    found = df.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)] or [0.5], 10_000).alias("q")).first()["q"] or []
    bounds = sorted(set(found))
    heavy = [b for b in bounds if found.count(b) > 1]
    # how many bounds aren't above the time: whole sixteens first, then within one
    ts, all_ = F.col("ts"), F.array(*map(F.lit, bounds)).cast("array<bigint>")
    tens = F.size(F.filter(F.array(*map(F.lit, bounds[15::16])).cast("array<bigint>"), lambda b: b <= ts))
    n = 16 * tens + F.size(F.filter(F.slice(all_, 16 * tens + 1, 16), lambda b: b <= ts))
    return F.when(ts.isNull(), -2).otherwise(2 * n + (~ts.isin(heavy)).cast("int")).cast("bigint")


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """records: record_id, url, ts (bigint), kind ('response' or 'revisit'), etag, last_modified, digest, headers (array of (name, value)).

    One row for each revisit: record_id, canonical_url, ts, refers_to, verdict (etag, last-modified, digest, changed or unresolved) and headers;
    refers_to and the merged headers are there if a validator agrees.
    """
    # null URLs meet under a key that no URL has, as they begin with a letter or digit once they are canonical
    df = records.withColumn("canonical_url", canonical(F.col("url"))).withColumn("k", F.coalesce("canonical_url", F.lit("\x00"))).withColumn("at", F.coalesce(F.col("ts"), F.lit(_LONG_AGO)))
    df = df.withColumn("slice", _slice(df, slices))
    salt = F.when(F.pmod("slice", F.lit(2)) == 0, F.pmod(F.xxhash64("record_id"), F.lit(SALTS))).otherwise(0)
    df = df.withColumn("salt", salt).withColumn("full", F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "last_modified", "digest", "headers")))
    earlier = Window.partitionBy("k", "slice", "salt").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    here = df.withColumn("near", F.max("full").over(earlier)).filter(F.col("kind") == "revisit")
    last = df.groupBy("k", "slice").agg(F.max("full").alias("full"))
    far = last.withColumn("far", F.max("full").over(Window.partitionBy("k").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1))).select("k", "slice", "far")
    got = here.join(far, ["k", "slice"], "left").withColumn("hit", F.coalesce("near", "far"))
    hit = F.col("hit")
    by_tag = F.col("etag").isNotNull() & hit["etag"].isNotNull()
    by_date = F.col("last_modified").isNotNull() & hit["last_modified"].isNotNull()
    verdict = (
        F.when(hit.isNull(), "unresolved")
        .when(by_tag, F.when(_opaque(F.col("etag")) == _opaque(hit["etag"]), "etag").otherwise("changed"))
        .when(by_date, F.when(F.col("last_modified") == hit["last_modified"], "last-modified").otherwise("changed"))
        .when(F.col("digest") == hit["digest"], "digest")
        .otherwise("changed")
    )
    got = got.withColumn("verdict", verdict)
    good = ~F.col("verdict").isin("unresolved", "changed")
    return got.select("record_id", "canonical_url", "ts", F.when(good, hit["record_id"]).alias("refers_to"), "verdict", F.when(good, merged(hit["headers"], F.col("headers"))).alias("headers"))


def _headers(**named: Column) -> Column:
    return F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("name"), v.cast("string").alias("value")) for k, v in named.items()))


def crawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl of `pages`, which has no headers: each page is a response, is asked for again right after, and brings
    its host's robots.txt along, of which only every third is a full response and which changes every 40 pages: its revisits
    refer to what other pages brought. Every fifth page's revisit has a stale ETag, every seventh none but a date, every eleventh only a digest."""
    p = F.coalesce("page_id", F.lit(0))
    digest, date = F.md5(F.coalesce("html", F.lit("")).cast("binary")), (p % 1000).cast("string")
    base = pages.select("url", p.alias("p"), digest.alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n"), date.alias("date"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    full = F.col("p") % 3 == 0
    version = F.concat(F.lit("r"), F.floor(F.col("p") / 40).cast("string"))
    asked = (F.col("p") % 7 != 0) & (F.col("p") % 11 != 0)
    old = _headers(cache_control=F.lit("max-age=60"), content_length=F.col("n"), content_type=F.lit("text/html"), date=F.col("date"))
    fresh = _headers(content_length=F.lit(0), date=(F.col("p") + 1) % 1000, expires=F.lit("0"))

    def record(nth: int, kind: Column, etag: Column, modified: Column, digest: Column, headers: Column, url: Column) -> DataFrame:
        at = 4 * F.col("p") + nth
        return base.select(at.alias("record_id"), url.alias("url"), at.alias("ts"), kind.alias("kind"), etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), headers.alias("headers"))

    response = record(0, F.lit("response"), F.when(F.col("p") % 11 != 0, tag), F.col("date"), F.col("digest"), old, F.col("url"))
    weak = F.when(F.col("p") % 5 == 0, F.lit('"stale"')).when(asked, F.concat(F.lit("W/"), tag))
    revisit = record(1, F.lit("revisit"), weak, F.when(F.col("p") % 11 != 0, F.col("date")), F.col("digest"), fresh, F.col("url"))
    robots = record(
        2, F.when(full, "response").otherwise("revisit"), F.when(full, version).when(asked, F.concat(F.lit("W/"), version)), F.when(full | (F.col("p") % 11 != 0), version), F.md5(version.cast("binary")),
        F.when(full, _headers(cache_control=F.lit("max-age=9"), content_length=F.col("p"), content_type=F.lit("text/plain"), date=F.col("date"))).otherwise(fresh),
        F.regexp_replace("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*).*$", "$1/robots.txt"),
    )
    return response.unionByName(revisit).unionByName(robots)


def headers_as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "; "))


ORACLE = r"""
with b as (
  select coalesce(page_id, 0) as p, url, md5(coalesce(html, '')) as digest, length(coalesce(html, '')) as n, cast(coalesce(page_id, 0) % 1000 as varchar) as date, 'r' || (coalesce(page_id, 0) // 40) as version
  from pages
), rec as (
  select 4 * p as id, p, url, 'response' as kind, case when p % 11 <> 0 then '"' || substr(digest, 1, 12) || '"' end as tag, date as modified, digest, 'max-age=60' as cache, n as len, 'text/html' as type from b
  union all
  select 4 * p + 1, p, url, 'revisit', case when p % 5 = 0 then '"stale"' when p % 7 <> 0 and p % 11 <> 0 then '"' || substr(digest, 1, 12) || '"' end, case when p % 11 <> 0 then date end, digest, null, null, null from b
  union all
  select 4 * p + 2, p, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*).*$', '\1/robots.txt'), case when p % 3 = 0 then 'response' else 'revisit' end,
    case when p % 3 = 0 or (p % 7 <> 0 and p % 11 <> 0) then version end, case when p % 3 = 0 or p % 11 <> 0 then version end, md5(version), 'max-age=9', p, 'text/plain' from b
), bare as (
  select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/@]*@)?', '') as bare from rec
), c as (
  select *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$'))) as kept from bare
), r as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical_url
  from c
), f as (
  select id as fid, canonical_url as u, tag as own_tag, modified as own_modified, digest as own_digest, cache as own_cache, len as own_len, type as own_type from r where kind = 'response'
), j as (
  select v.*, f.* from (select * from r where kind = 'revisit') v asof left join f on v.canonical_url = f.u and v.id > f.fid
), d as (
  select *, case when fid is null then 'unresolved'
    when tag is not null and own_tag is not null then case when tag = own_tag then 'etag' else 'changed' end
    when modified is not null and own_modified is not null then case when modified = own_modified then 'last-modified' else 'changed' end
    when digest = own_digest then 'digest' else 'changed' end as verdict
  from j
)
select id as record_id, canonical_url, id as ts, case when verdict not in ('unresolved', 'changed') then fid end as refers_to, verdict,
  case when verdict not in ('unresolved', 'changed') then 'cache-control: ' || own_cache || '; content-length: ' || own_len || '; content-type: ' || own_type || '; date: ' || cast((p + 1) % 1000 as varchar) || '; expires: 0' end as headers
from d
"""
