"""Not-modified revisits of web archives: each takes its content from an earlier full response.

A revisit record (status 304) has no body. It is joined as of its time to the latest earlier full response of the
same canonical URL. Its validators are checked against that response: entity tags by weak comparison where both
records have one, else the dates of last modification. Where they agree, the response's headers are taken over and
those that a 304 may replace are replaced by the revisit's.

The join runs on (URL, span of time), so a URL with very many captures is dealt over tasks: within a span a
running maximum finds the latest response; the spans' last responses, one row for each span, are carried forward
and joined to the revisits that have none within their own span.

Defined results: outcome is resolved, mismatch (validators differ), unverified (no validator on either side to
compare; headers are merged as for resolved) or orphan (no earlier full response); records with a null time, or with
a URL that is null or has neither host nor path, are orphans; a response at the same
time as the revisit is not earlier; among responses of one time the largest record_id counts; repeated revisits
each give a row; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Header fields of a stored response that a 304 response must not replace (lower case).
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade", "set-cookie")
#: Query parameters that don't choose the content.
IGNORED_PARAMETERS = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "sessionid")


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host in lower case without www. and default port, parameters sorted, no slash at the end."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).isin(*IGNORED_PARAMETERS)))
    joined = F.array_join(kept, "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def resolve(captures: DataFrame, span: int = 65_536) -> DataFrame:
    """One row for each revisit of ``captures``: record_id, url_key, ts, outcome, source_id, source_ts, headers.

    ``captures`` has record_id (long), url, ts (long), is_revisit (boolean), etag, last_modified (strings, null if
    absent) and headers (map of lower-case names to values). ``span`` is the length of a span of time."""
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"),
        F.coalesce(F.col("is_revisit"), F.lit(False)).alias("is_revisit"), "etag", "last_modified", "headers",
    )
    placed = rows.withColumn("at", F.expr(f"ts div {int(span)}"))
    known = F.coalesce(F.col("url_key") != "", F.lit(False)) & F.col("ts").isNotNull()
    full = F.when(~F.col("is_revisit"), F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    order = F.when(~F.col("is_revisit"), F.struct("ts", "record_id"))
    before = Window.partitionBy("url_key", "at").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.where(known).withColumn("near", F.max_by(full, order).over(before)).where("is_revisit")
    lasts = placed.where(known & ~F.col("is_revisit")).groupBy("url_key", "at").agg(F.max_by(full, order).alias("last"))
    # a span's carried response is the last one of the spans before it: that of the nearest earlier span that has one
    wanted = near.where("near IS NULL").select("url_key", "at").distinct()
    spans = lasts.join(wanted.withColumn("wanted", F.lit(True)), ["url_key", "at"], "full_outer")
    earlier = Window.partitionBy("url_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).where("wanted").select("url_key", "at", "far")
    joined = near.where("near IS NOT NULL").withColumn("source", F.col("near")).drop("near")
    joined = joined.unionByName(near.where("near IS NULL").drop("near").join(carried, ["url_key", "at"], "left").withColumnRenamed("far", "source"))
    joined = joined.unionByName(placed.where(~known & F.col("is_revisit")).withColumn("source", F.lit(None).cast(joined.schema["source"].dataType)))
    tag = lambda c: F.regexp_replace(c, r"^[Ww]/", "")  # noqa: E731  weak comparison
    tags = tag(F.col("etag")) == tag(F.col("source.etag"))
    dates = F.col("last_modified") == F.col("source.last_modified")
    agrees = F.coalesce(tags, dates)
    outcome = F.when(F.col("source").isNull(), "orphan").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified")
    new = F.map_filter(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*KEPT_HEADERS))
    old = F.coalesce(F.col("source.headers"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", "outcome", F.col("source.record_id").alias("source_id"), F.col("source.ts").alias("source_ts"),
        F.when(F.col("outcome").isin("resolved", "unverified"), merged).alias("headers"),
    )


def captures_of(pages: DataFrame, later: int = 500) -> DataFrame:
    """A capture log from a table of pages: each page is fetched whole at the time of its id and asked for again
    ``later`` ticks after that by an address with another spelling.

    Responses have an entity tag of their html and a date of last modification, the same for ten pages each; pages
    whose id leaves 3 by 7 have neither. What a revisit has to validate depends on its id modulo 7: its own page's tag
    and date; for 1 the date alone; for 2 nothing; for 5 a tag that no page has; and for 4 it asks for an address that was never fetched."""
    kind = F.pmod(F.col("page_id"), F.lit(7))
    whole = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(whole.cast("binary")), F.lit('"'))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), tag.alias("tag"), F.length(whole).cast("string").alias("size"))
    base = base.withColumn("changed", F.concat(F.lit("day "), F.expr("page_id div 10").cast("string")))
    text = lambda c: F.col(c).cast("string")
    entries = lambda **h: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in h.items())), lambda e: e["value"].isNotNull()))
    first_tag, first_date = F.when(kind != 3, F.col("tag")), F.when(kind != 3, F.col("changed"))
    again_tag, again_date = F.when(kind == 5, F.lit('"stale"')).when(~kind.isin(1, 2), F.concat(F.lit("W/"), F.col("tag"))), F.when(kind != 2, F.col("changed"))
    address = F.concat(F.regexp_replace("url", "[#?].*$", ""), F.when(kind == 4, F.concat(F.lit("/never-"), text("page_id"))).otherwise(F.regexp_extract("url", r"(\?[^#]*)", 1)), F.lit("#again"))
    kinds = F.array(
        F.struct(
            (F.col("page_id") * 2).alias("record_id"), F.col("url").alias("url"), F.col("page_id").alias("ts"), F.lit(False).alias("is_revisit"), first_tag.alias("etag"), first_date.alias("last_modified"),
            entries(content_length=F.col("size"), content_type=F.lit("text/html"), etag=first_tag, last_modified=first_date, date=text("page_id")).alias("headers"),
        ),
        F.struct(
            (F.col("page_id") * 2 + 1).alias("record_id"), address.alias("url"), (F.col("page_id") + later).alias("ts"), F.lit(True).alias("is_revisit"), again_tag.alias("etag"), again_date.alias("last_modified"),
            entries(content_length=F.lit("0"), etag=again_tag, date=(F.col("page_id") + later).cast("string"), x_cache=F.lit("revalidated")).alias("headers"),
        ),
    )
    return base.select(F.explode(kinds).alias("c")).select("c.*")


def header_lines(headers: Column) -> Column:
    """A header map as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
