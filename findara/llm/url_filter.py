"""URL filters by a temporal list join.

List entries are dated: a pattern is added to a list, taken off it, added again.  They become validity intervals,
and every capture is judged by the entries that were active when it was fetched.

Patterns are domains, which match a host and all hosts below it, or beginnings of addresses, which match up to a
slash.  Both are equality joins: a host's domains, and an address's beginnings, are looked up, once for each
different host or address; captures then meet their host's intervals and an as-of condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name

#: Scheme, user, host; what follows up to a question or number sign is the path.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)"

#: Hosts with address patterns up to which they are broadcast.
NAMED = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"\.$", "")


def path_of(url: Column) -> Column:
    """The path, at least a slash."""
    found = F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))
    return F.when(found == "", F.lit("/")).otherwise(found)


def validity(entries: DataFrame) -> DataFrame:
    """``list, pattern, since, until`` (null: still valid) from dated entries (list, pattern, at, action).

    ``action`` is add or remove; of entries at the same time a removal comes last.  An entry holds until the next
    one of its list and pattern, so intervals do not overlap; those of no length, and entries without a time, are
    left out.  Patterns are compared in lower case, without a final dot.
    """
    pattern = F.regexp_replace(F.lower(F.trim("pattern")), r"\.$", "")
    rows = entries.select("list", pattern.alias("pattern"), "at", "action").filter("at is not null and pattern <> ''").distinct()
    following = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at", "action"))
    spans = rows.withColumn("until", following).filter((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
    return spans.select("list", "pattern", F.col("at").alias("since"), "until")


def _looked_up(keys: DataFrame, on: list[str], candidates: Column, spans: DataFrame, name: str) -> DataFrame:
    """For each different key that has any, the intervals of its candidate patterns, in one array.

    The array is as long as the history of one key's few patterns.
    """
    wanted = keys.select(*on).distinct().select(*on, F.explode(F.array_distinct(candidates)).alias("pattern"))
    found = wanted.join(spans, "pattern").groupBy(*on).agg(F.collect_list(F.struct("list", "pattern", "since", "until")).alias(name))
    return found


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures with ``host, lists, patterns`` (sorted arrays of what was active then) and ``blocked``.

    Rows stay rows, repeated ones too.  A capture without a host, or without a time, matches nothing and stays.
    An empty list blocks nothing.  Columns of ours whose names are taken get underscores appended.
    """
    spans = validity(entries)
    domains, starts = spans.filter(~F.col("pattern").contains("/")), spans.filter(F.col("pattern").contains("/"))
    rows = captures.select(F.struct(*captures.columns).alias("_row"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"), F.col(time_col).alias("_time"))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = _looked_up(rows.filter("_host <> ''"), ["_host"], suffixes, domains, "_by_host")
    # Only hosts that some address pattern names are taken apart by path.
    named = starts.select(F.substring_index("pattern", "/", 1).alias("_host")).distinct()
    if named.limit(NAMED + 1).count() <= NAMED:  # then no host's captures are moved to one task for this
        named = F.broadcast(named)
    parts = F.split("_path", "/")
    # The beginnings that end with a slash, and the whole.
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    addresses = F.transform(beginnings, lambda p: F.lower(F.concat(F.col("_host"), p)))
    by_path = _looked_up(rows.join(named, "_host", "left_semi"), ["_host", "_path"], addresses, starts, "_by_path")
    joined = rows.join(hosts, "_host", "left").join(by_path, ["_host", "_path"], "left")
    none = F.array().cast(hosts.schema["_by_host"].dataType)
    every = F.concat(F.coalesce("_by_host", none), F.coalesce("_by_path", none))
    active = F.filter(every, lambda e: (e["since"] <= F.col("_time")) & (e["until"].isNull() | (F.col("_time") < e["until"])))
    out = joined.select("_row", "_host", active.alias("_active"))
    names = {n: free_name(captures, n) for n in ("host", "lists", "patterns", "blocked")}
    distinct = lambda f: F.array_sort(F.array_distinct(F.transform("_active", lambda e: e[f])))
    return out.select("_row.*", F.col("_host").alias(names["host"]), distinct("list").alias(names["lists"]), distinct("pattern").alias(names["patterns"]), (F.size("_active") > 0).alias(names["blocked"]))


# The query's list: dated entries for known bad hosts and for parts of sites.
ENTRIES = [
    ("spam", "spam-farm.example.org", "2024-01-01 01:00:00", "add"),
    ("spam", "cheap-pills.example.com", "2024-01-01 00:30:00", "add"),
    ("spam", "cheap-pills.example.com", "2024-01-02 00:00:00", "remove"),
    ("spam", "cheap-pills.example.com", "2024-01-03 12:00:00", "add"),
    ("mirror", "example.net/de/", "2024-01-01 00:00:00", "add"),
    ("mirror", "thther.example.org/en/", "2024-01-01 02:00:00", "add"),
    ("mirror", "thther.example.org/en/", "2024-01-05 00:00:00", "remove"),
]


def dated_entries(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The fixed entries, and a review list whose dates follow from a digest of each host: the list grows with the hosts."""
    fixed = spark.createDataFrame(ENTRIES, "list string, pattern string, at string, action string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    host = pages.select(host_of(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    number = F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long")
    steps = [(3, 0, "add"), (6, 600, "remove"), (12, 1200, "add")]
    change = F.array(*[F.when(F.col("number") % every == 0, F.struct((F.col("number") % 2000 + later).alias("minute"), F.lit(action).alias("action"))) for every, later, action in steps])
    rows = host.withColumn("number", number).select("pattern", F.explode(F.array_compact(change)).alias("c"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    review = rows.select(F.lit("review").alias("list"), "pattern", (start + F.make_dt_interval(mins=F.col("c.minute").cast("int"))).alias("at"), F.col("c.action").alias("action"))
    return fixed.unionByName(review)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched a minute after the one before it, against the entries active at that time."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    fetched = start + F.make_dt_interval(days=F.floor(F.col("page_id") / 1440).cast("int"), mins=F.pmod("page_id", F.lit(1440)).cast("int"))
    captures = pages.withColumn("fetched_at", fetched)
    judged = judge(captures, dated_entries(spark, pages))
    return judged.select("page_id", "host", F.col("fetched_at").cast("string").alias("fetched_at"), F.array_join("lists", ",").alias("lists"), F.array_join("patterns", ",").alias("patterns"), "blocked")


_FIXED = ", ".join(f"('{a}', '{p}', TIMESTAMP '{t}', '{x}')" for a, p, t, x in ENTRIES)

SQL = {
    "op7_url_filter": rf"""
        WITH c AS (SELECT page_id, regexp_replace(lower(coalesce(regexp_extract(url, '{HOST}', 1), '')), '\.$', '') AS host,
                   CASE WHEN coalesce(regexp_extract(url, '{PATH}', 1), '') = '' THEN '/' ELSE regexp_extract(url, '{PATH}', 1) END AS path,
                   TIMESTAMP '2024-01-01' + to_minutes(page_id) AS t FROM pages),
             h AS (SELECT DISTINCT host AS pattern, ('0x' || substring(md5(host), 1, 8))::BIGINT AS n FROM c WHERE host <> ''),
             e AS (SELECT * FROM (VALUES {_FIXED}) v(list, pattern, moment, action)
                   UNION ALL SELECT 'review', pattern, TIMESTAMP '2024-01-01' + to_minutes(n % 2000), 'add' FROM h WHERE n % 3 = 0
                   UNION ALL SELECT 'review', pattern, TIMESTAMP '2024-01-01' + to_minutes(n % 2000 + 600), 'remove' FROM h WHERE n % 6 = 0
                   UNION ALL SELECT 'review', pattern, TIMESTAMP '2024-01-01' + to_minutes(n % 2000 + 1200), 'add' FROM h WHERE n % 12 = 0),
             s AS (SELECT list, pattern, moment AS since, action, lead(moment) OVER (PARTITION BY list, pattern ORDER BY moment, action) AS until FROM e),
             m AS (SELECT c.page_id, s.list, s.pattern FROM c JOIN s ON s.action = 'add' AND s.since <= c.t AND (s.until IS NULL OR c.t < s.until)
                   WHERE CASE WHEN contains(s.pattern, '/') THEN starts_with(lower(c.host || c.path), s.pattern) AND (ends_with(s.pattern, '/') OR lower(c.host || c.path) = s.pattern)
                         ELSE c.host = s.pattern OR ends_with(c.host, '.' || s.pattern) END)
        SELECT c.page_id, c.host, strftime(c.t, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists,
               coalesce(string_agg(DISTINCT m.pattern, ',' ORDER BY m.pattern), '') AS patterns, count(m.list) > 0 AS blocked
        FROM c LEFT JOIN m ON m.page_id = c.page_id GROUP BY c.page_id, c.host, c.t""",
}
