"""WARC revisits: not-modified records resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Headers of a 304 response that may replace those of the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change what a URL names.
TRACKING = r"(?i)^(utm_[^=]*|gclid|fbclid|ref|sessionid)(=|$)"
SLAB_S = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no user info, default port, fragment or tracking parameters, parameters in order, / for no path.

    http and https name the same resource here, so the scheme is left out; null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^(?i)https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^.*@", ""), r":(80|443)$", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of equal names the last counts."""
    empty = F.expr("cast(map() as map<string, string>)")
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key: string, value: string>>)"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    one = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"].alias("value")))
    return F.coalesce(F.map_from_entries(one), empty)


def merged(stored: Column, update: Column) -> Column:
    """The stored headers with the permitted ones of the 304 response in their place, in order of name."""
    new = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(old, new))))


def resolve_revisits(records: DataFrame, slab_s: int = SLAB_S) -> DataFrame:
    """One row per not-modified revisit: record_id, url_key, at, response_id, status, headers, payload_digest.

    records: record_id, url, at (epoch seconds), kind ('response' or 'revisit'), http_status, headers (map), payload_digest.
    A revisit stands for the latest response with status 200 of its canonical URL before it (at smaller; of ties the largest record_id).
    Status: no_response; mismatch, if both state an entity tag (weak marks left out) or, where either states none, both
    state a last modification, and these differ; unchecked, if they state no validator in common; else resolved. Headers are merged and the digest
    taken over unless there is no response or a mismatch. Records without URL or time match nothing; other kinds of
    record are left out; repeated revisits stay, repeated responses change nothing.

    Rows are dealt by (URL, time slab), so a URL with very many captures is many small groups; from slab to slab only the last
    response of each travels.
    """
    rows = records.select(
        F.col("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long").alias("at"),
        (F.col("kind") == "response").alias("is_response"), F.col("http_status").cast("int").alias("http_status"), _lowered(F.col("headers")).alias("headers"), "payload_digest")
    rows = rows.where((F.col("is_response") & (F.col("http_status") == 200) & F.col("url_key").isNotNull() & F.col("at").isNotNull())
                      | (~F.col("is_response") & (records.kind == "revisit")))
    held = F.when(F.col("is_response"), F.struct("at", "record_id", "headers", "payload_digest"))
    rows = rows.withColumn("_slab", F.floor(F.col("at") / slab_s)).withColumn("_held", held)
    inside = Window.partitionBy("url_key", "_slab").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    summary = rows.where("is_response").groupBy("url_key", "_slab").agg(F.max_by("_held", F.struct("at", "record_id")).alias("_last"))
    visits = rows.where(~F.col("is_response")).select("url_key", "_slab").distinct()
    across = Window.partitionBy("url_key").orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = (summary.join(visits, ["url_key", "_slab"], "full").withColumn("_carried", F.last("_last", ignorenulls=True).over(across)).select("url_key", "_slab", "_carried"))
    latest = F.max_by("_held", F.when(F.col("is_response"), F.struct("at", "record_id"))).over(inside)
    seen = rows.withColumn("_near", latest).where(~F.col("is_response")).drop("_held", "is_response", "http_status", "payload_digest")
    joined = seen.join(carried, (seen.url_key == carried.url_key) & (seen._slab == carried._slab), "left").select(
        "record_id", seen.url_key, "at", F.col("headers").alias("_new"), F.coalesce("_near", "_carried").alias("_r"))
    tag = lambda h: F.regexp_replace(_header(h, "etag"), "^W/", "")
    tags = tag(F.col("_new")) == tag(F.col("_r.headers"))
    dates = _header(F.col("_new"), "last-modified") == _header(F.col("_r.headers"), "last-modified")
    same = F.coalesce(tags, dates)
    status = F.when(F.col("_r").isNull(), "no_response").when(~same, "mismatch").when(same.isNull(), "unchecked").otherwise("resolved")
    taken = F.col("status").isin("resolved", "unchecked")
    return joined.withColumn("status", status).select(
        "record_id", "url_key", "at", F.col("_r.record_id").alias("response_id"), "status",
        F.when(taken, merged(F.col("_r.headers"), F.col("_new"))).otherwise(F.col("_new")).alias("headers"),
        F.when(taken, F.col("_r.payload_digest")).alias("payload_digest"))
