"""URL filters by a temporal list join: dated list entries become validity intervals, captures meet the entries of their day.

DataFrame functions only. A list is a log of entries: on a day, a pattern is added to or removed from the block or the
allow list. A pattern is a host, a domain with all its hosts, or a host with the first segments of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
#: Days of one join bucket: an interval gets a row for each bucket that it touches, a capture looks into one.
BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """Host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def segments_of(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda s: s != F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, listed, from_day, to_day): when each pattern was on a list; `to_day` is excluded, null if still listed.

    `entries(pattern, listed, action, day)`: `listed` is block or allow, `action` add or remove. Of several entries of a pattern and
    list on a day an add wins. Entries with a null field are no entries; repeats change nothing. One row per pattern, list and day is
    left before the window, so a pattern with very many entries is as long there as the calendar.
    """
    valid = entries.filter("pattern IS NOT NULL AND listed IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    daily = valid.groupBy("pattern", "listed", "day").agg(F.bool_or(F.col("action") == "add").alias("on"))
    order = W.partitionBy("pattern", "listed").orderBy("day")
    turns = daily.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).filter("on <> was")
    ends = turns.withColumn("to_day", F.lead("day").over(order)).filter("on")
    return ends.select("pattern", "listed", F.col("day").alias("from_day"), "to_day")


def patterns_of(url: Column, depth: int) -> Column:
    """Every pattern that covers the URL: its host, its domains, its host with up to `depth` path segments."""
    host, labels, parts = host_of(url), F.split(host_of(url), "\\."), F.slice(segments_of(url), 1, max(depth, 1))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))
    )
    some = F.when((F.size(parts) > 0) & F.lit(depth > 0), prefixes).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.concat(F.lit("host:"), host)), domains, some)
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def rank_of(pattern: Column) -> Column:
    """How specific a kind of pattern is: prefix, host, domain."""
    return F.when(pattern.startswith("prefix:"), 2).when(pattern.startswith("host:"), 1).otherwise(0)


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures(page_id, url, day)` with `n_active`, `pattern`, `listed` and `kept`: one row per row.

    `n_active` counts the entries active on the day of the capture. The most specific active pattern decides: the longest path prefix, else the
    host itself, else the longest domain; block goes before allow for the same pattern. Without one the capture is kept. A null URL, one without host, and a null day meet no entry and are kept.
    """
    spans = intervals(entries)
    deepest = spans.filter("pattern LIKE 'prefix:%'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    last = captures.agg(F.max("day")).first()[0] or 0
    listed = spans.filter(F.col("from_day") <= F.lit(last)).withColumn(
        "bucket", F.explode(F.expr(f"sequence(from_day DIV {BUCKET_DAYS}, coalesce(to_day - 1, {int(last)}) DIV {BUCKET_DAYS})"))
    )
    wanted = captures.select("page_id", "url", "day").filter("day IS NOT NULL").distinct()
    wanted = wanted.select(
        "page_id", "url", "day", F.explode(patterns_of(F.col("url"), deepest)).alias("pattern"), F.expr(f"day DIV {BUCKET_DAYS}").alias("bucket")
    )
    met = wanted.join(listed, ["pattern", "bucket"]).filter("day >= from_day AND (to_day IS NULL OR day < to_day)")
    best = F.max(F.struct(rank_of(F.col("pattern")).alias("rank"), F.length("pattern").alias("n"), (F.col("listed") == "block").alias("block"), "pattern", "listed"))
    verdict = met.groupBy("page_id", "url", "day").agg(F.count("*").alias("n_active"), best.alias("best"))
    verdict = verdict.select("n_active", "best", *(F.col(k).alias(f"v_{k}") for k in ("page_id", "url", "day")))
    on = [F.col(k).eqNullSafe(F.col(f"v_{k}")) for k in ("page_id", "url", "day")]
    return captures.select("page_id", "url", "day").join(verdict, on, "left").select(
        "page_id", "url", "day", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("best.pattern").alias("pattern"),
        F.col("best.listed").alias("listed"), F.coalesce(~F.col("best.block"), F.lit(True)).alias("kept"),
    )


def derived_entries(pages: DataFrame) -> DataFrame:
    """A list log made from `pages`: each page reports its host, domain or first path segment on a day of its own."""
    url = F.col("url")
    labels = F.split(host_of(url), "\\.")
    kinds = F.when(F.col("page_id") % 7 < 3, F.concat(F.lit("prefix:"), host_of(url), F.lit("/"), F.get(segments_of(url), F.lit(0))))
    kinds = kinds.when(F.col("page_id") % 7 < 6, F.concat(F.lit("host:"), host_of(url)))
    kinds = kinds.otherwise(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.size(labels)), ".")))
    return pages.filter(host_of(url) != "").select(
        kinds.alias("pattern"),
        F.when(F.col("page_id") % 5 < 3, "block").otherwise("allow").alias("listed"),
        F.when(F.expr("page_id DIV 35 % 3") < 2, "add").otherwise("remove").alias("action"),
        (F.col("page_id") * 7919 % 997).alias("day"),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture, fetched on a day of its own."""
    return pages.select("page_id", "url", (F.col("page_id") * 104729 % 1009).alias("day"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, page_id * 104729 % 1009 AS day,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages
), e AS (
  SELECT CASE WHEN page_id % 7 < 3 THEN 'prefix:' || host || '/' || seg[1] WHEN page_id % 7 < 6 THEN 'host:' || host
      ELSE 'domain:' || array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 2, 1):], '.') END AS pattern,
    CASE WHEN page_id % 5 < 3 THEN 'block' ELSE 'allow' END AS listed,
    page_id // 35 % 3 < 2 AS add_it, page_id * 7919 % 997 AS day
  FROM u WHERE host <> ''
), d AS (SELECT pattern, listed, day, bool_or(add_it) AS state FROM e WHERE pattern IS NOT NULL GROUP BY ALL),
s AS (SELECT pattern, listed, day AS from_day, lead(day) OVER (PARTITION BY pattern, listed ORDER BY day) AS to_day, state FROM d),
c AS (
  SELECT page_id, url, day, unnest(list_concat(['host:' || host],
      [('domain:' || array_to_string(string_split(host, '.')[i:], '.')) for i in range(1, len(string_split(host, '.')) + 1)],
      [('prefix:' || host || '/' || array_to_string(seg[1:i], '/')) for i in range(1, len(seg) + 1)])) AS pattern
  FROM (SELECT DISTINCT * FROM u WHERE host <> '')
), m AS (
  SELECT c.page_id, c.url, c.day, c.pattern, s.listed FROM c JOIN s ON c.pattern = s.pattern AND s.state AND c.day >= s.from_day
    AND (s.to_day IS NULL OR c.day < s.to_day)
), b AS (
  SELECT page_id, url, day, count(*) AS n_active, arg_max({'p': pattern, 'l': listed}, {'r': CASE WHEN starts_with(pattern, 'prefix:') THEN 2 WHEN starts_with(pattern, 'host:') THEN 1 ELSE 0 END, 'n': length(pattern), 'b': listed = 'block', 'p': pattern}) AS best
  FROM m GROUP BY ALL
)
SELECT u.page_id, u.url, u.day, coalesce(b.n_active, 0) AS n_active, b.best.p AS pattern, b.best.l AS listed, coalesce(b.best.l <> 'block', true) AS kept
FROM u LEFT JOIN b ON u.page_id IS NOT DISTINCT FROM b.page_id AND u.url IS NOT DISTINCT FROM b.url AND u.day IS NOT DISTINCT FROM b.day
"""
