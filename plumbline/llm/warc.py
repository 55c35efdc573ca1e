"""Operator 3, resolving not-modified revisits in web archives.

A revisit record has only headers; its content is that of the latest full response
for the same URL captured earlier. Records, without bodies, are put in ranges of (canonical URL, time) and
written once, so a URL with many captures lies in as many ranges as it fills; the as-of join is a running last non-null
within a range, and what a range takes over from those before it is one response for the URL it begins with. Validators are then compared and the headers that a
304 may change are merged into the stored ones (RFC 9111, sections 3.2 and 4.3.4).

Defined cases: a response at the same instant isn't earlier; of responses at one
instant the one with the largest record_id is the latest. A record whose URL, time or kind is null
takes part in nothing; such a revisit has status `no_response`. Ids may be of any type that has an order. A port is left out where it is its scheme's own; an
address without a scheme counts as http. Null headers count as none. Entity tags are compared weakly and before dates; where both
sides lack a common validator the status is `unvalidated`, and nothing is merged. Repeated records are kept.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import cluster

#: headers of a 304 that must not replace stored ones
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "^(utm_.*|fbclid|gclid|ref)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a last slash, query without tracking parameters and sorted; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    named = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", "")
    host = F.when(F.trim(url).rlike("^(?i)https://"), F.regexp_replace(named, ":443$", "")).otherwise(F.regexp_replace(named, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _header(headers: str, name: str) -> Column:
    return F.try_element_at(F.col(headers), F.lit(name))


def _tag(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, response_id, status and merged headers of every revisit; records: record_id, url, ts, kind (response or revisit) and headers with names in lower case."""
    none = F.create_map().cast("map<string,string>")
    r = records.select("record_id", canonical_url(F.col("url")).alias("u"), F.col("ts").alias("t"), F.col("kind").alias("k"), F.coalesce(F.col("headers"), none).alias("h")).where("k in ('response', 'revisit')")
    stored = F.struct(F.col("record_id").alias("id"), "h")
    # revisits before responses of the same instant
    order = ["u", "t", F.when(F.col("k") == "revisit", 0).otherwise(1), "record_id"]
    ranged = cluster.written(r.where("u is not null and t is not null").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # URLs that begin a range and may have begun before it; a row or two for each range
    edge = ranged.groupBy("part").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    ends = edge.select(F.explode(F.array("lo", "hi")).alias("e")).distinct()
    last = ranged.where("k = 'response'").join(F.broadcast(ends), F.col("u") == F.col("e"), "left_semi").groupBy("part", "u").agg(F.max_by(stored, F.struct("t", "record_id")).alias("s"))
    begun = edge.select("part", F.col("lo").alias("u")).unionByName(last.select("part", "u")).distinct().join(last, ["part", "u"], "left")
    before = Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    taken = begun.select(F.col("part").alias("bp"), F.col("u").alias("bu"), F.last("s", ignorenulls=True).over(before).alias("over")).where("over is not null")
    inside = Window.partitionBy("part", "u").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("k") == "response", stored), ignorenulls=True).over(inside)
    asof = ranged.withColumn("own", own).where("k = 'revisit'").join(F.broadcast(taken), (F.col("part") == F.col("bp")) & (F.col("u") == F.col("bu")), "left")
    found = asof.select("record_id", "h", F.coalesce("own", "over").alias("stored")).select("record_id", "h", F.col("stored.id").alias("response_id"), F.col("stored.h").alias("old"))
    lost = r.where("k = 'revisit' and (u is null or t is null)").select("record_id", "h", F.lit(None).cast(found.schema["response_id"].dataType).alias("response_id"), F.lit(None).cast("map<string,string>").alias("old"))
    joined = found.unionByName(lost)
    tags = _header("h", "etag").isNotNull() & _header("old", "etag").isNotNull()
    dates = _header("h", "last-modified").isNotNull() & _header("old", "last-modified").isNotNull()
    good = F.when(tags, _tag(_header("h", "etag")) == _tag(_header("old", "etag"))).when(dates, F.trim(_header("h", "last-modified")) == F.trim(_header("old", "last-modified")))
    status = F.when(F.col("response_id").isNull(), "no_response").when(good.isNull(), "unvalidated").when(good, "resolved").otherwise("validator_mismatch")
    new = F.map_filter("h", lambda k, v: ~k.isin(*KEPT))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    return joined.withColumn("status", status).select("record_id", "response_id", "status", F.when(F.col("status") == "resolved", lines).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records of the pages table: a full response for every page at the time page_id, and a revisit of it a little later (or, for one in sixteen, earlier) under another spelling of the URL, of which some carry another validator."""
    digest = F.md5(F.coalesce(F.col("html").cast("string"), F.lit("")))
    base = pages.select(F.col("page_id").cast("bigint").alias("p"), F.col("url").cast("string").alias("url"), digest.alias("d"), F.octet_length(F.col("html").cast("string")).alias("n"))
    tag = F.concat(F.lit('"'), F.substring("d", 1, 16), F.lit('"'))
    first = F.substring("d", 1, 1)
    stored = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("n").cast("string"), F.lit("etag"), tag, F.lit("last-modified"), F.concat(F.lit("t"), F.col("p").cast("string")), F.lit("server"), F.lit("origin"))
    sent = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), F.when(first < "4", F.concat(F.lit("W/"), tag)).when(first < "6", F.lit('"changed"')).otherwise(tag), F.lit("cache-control"), F.lit("max-age=60"), F.lit("connection"), F.lit("close"), F.lit("date"), F.concat(F.lit("t"), (F.col("p") + 7).cast("string")))
    other = F.concat(F.lit("HTTPS://WWW."), F.regexp_replace(F.regexp_replace("url", "^https?://(www[.])?", ""), "#.*$", ""), F.lit("#seen"))
    both = F.array(
        F.struct((F.col("p") * 2).alias("record_id"), F.col("url").alias("url"), F.col("p").alias("ts"), F.lit("response").alias("kind"), stored.alias("headers")),
        F.struct((F.col("p") * 2 + 1).alias("record_id"), other.alias("url"), (F.col("p") + F.when(first == "f", -3).otherwise(7)).cast("bigint").alias("ts"), F.lit("revisit").alias("kind"), sent.alias("headers")),
    )
    return base.select(F.explode(both).alias("r")).select("r.*")
