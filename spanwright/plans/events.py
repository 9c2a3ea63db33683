"""Queries over events: sequences by user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, joins, windows
from ..session import stash, table
from ..streaming import limiter
from .registry import query

US = 1_000_000


def events(spark, d):
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""SELECT user_id, rn, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM events WHERE value < 40) WHERE rn <= 5""")
def review_topk(spark, d):
    """The five least values of each user under a threshold."""
    return windows.top_k(table(spark, d, "events").filter("value < 40"), ["user_id"], ["value", "event_id"], 5).select("user_id", F.col("rn").cast("long").alias("rn"), "event_id", "value")


@query("""SELECT user_id, island, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM
 (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 10 THEN 1 ELSE 0 END AS new FROM events WHERE value IS NOT NULL)) GROUP BY user_id, island""")
def value_islands(spark, d):
    """Single-linkage clusters of a user's values, split where the gap exceeds 10."""
    c = windows.islands(table(spark, d, "events").filter("value is not null"), ["user_id"], ["value", "event_id"], "value", 10.0)
    return c.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(gap) AS n_gaps, max(gap)::BIGINT AS max_gap, max(gap) <= greatest(36 * {US}::BIGINT, 2.2 * median(gap)) AS even FROM g GROUP BY user_id HAVING count(gap) > 0""")
def max_gap_gate(spark, d):
    """Whether a user's largest gap between events stays within a multiple of the median."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    g = events(spark, d).select("user_id", (F.col("us") - F.lag("us").over(w)).alias("gap"))
    g = g.groupBy("user_id").agg(F.count("gap").alias("n_gaps"), F.max("gap").alias("max_gap"), F.percentile("gap", 0.5).alias("m")).filter("n_gaps > 0")
    return g.select("user_id", "n_gaps", "max_gap", (F.col("max_gap") <= F.greatest(F.lit(36.0 * US), 2.2 * F.col("m"))).alias("even"))


@query("""SELECT user_id, run, event_type, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM
 (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL""")
def type_runs(spark, d):
    return windows.runs(events(spark, d), ["user_id"], ["us", "event_id"], "event_type")


@query("""WITH x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) - 1 AS missing FROM x)
SELECT user_id, CAST(day AS VARCHAR) AS until_day, missing FROM g WHERE missing >= 2""")
def empty_day_gaps(spark, d):
    """Runs of two or more days without an event of the user."""
    x = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    g = x.withColumn("missing", (F.date_diff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))) - 1).cast("long"))
    return g.filter("missing >= 2").select("user_id", F.col("day").cast("string").alias("until_day"), "missing")


@query(f"""WITH i AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600 * {US}::BIGINT AS e FROM events), n AS (SELECT *, greatest(s, coalesce(lag(e) OVER w, s)) AS cs, least(e, coalesce(lead(s) OVER w, e)) AS ce FROM i WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT event_id, CASE WHEN cs < ce THEN cs ELSE s END AS clip_start, CASE WHEN cs < ce THEN ce ELSE e END AS clip_end FROM n""")
def neighbour_clip(spark, d):
    """An hour from each event, cut at its neighbours."""
    i = events(spark, d).select("event_id", "user_id", F.col("us").alias("s"), (F.col("us") + F.lit(3600 * US).cast("long")).alias("e"))
    return windows.clip_to_neighbours(i, ["user_id"], ["s", "event_id"], "s", "e").select("event_id", "clip_start", "clip_end")


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY p_size) AS idx, p_size::DOUBLE AS centre FROM (SELECT DISTINCT p_size FROM part)),
m AS (SELECT event_id, idx, centre, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - centre), idx) AS rn FROM events JOIN c ON abs(value - centre) <= 0.5)
SELECT event_id, idx, centre FROM m WHERE rn = 1""")
def nearest_centre(spark, d):
    """The nearest of the parts' sizes within a tolerance, the first of ties: an equi join on the whole numbers in reach."""
    sizes = table(spark, d, "part").select(F.col("p_size").cast("double").alias("centre")).distinct()
    c = sizes.withColumn("idx", F.row_number().over(Window.orderBy("centre")).cast("long"))  # as many rows as there are sizes
    e = table(spark, d, "events").filter("value is not null").select("event_id", "value")
    e = e.withColumn("centre", F.explode(F.array_distinct(F.array(F.floor("value").cast("double"), F.ceil("value").cast("double"))))).filter(F.abs(F.col("value") - F.col("centre")) <= 0.5)
    return windows.first_wins(e.join(c, "centre").withColumn("dist", F.abs(F.col("value") - F.col("centre"))), ["event_id"], ["dist", "idx"]).select("event_id", "idx", "centre")


@query("""WITH e AS (SELECT *, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
x AS (SELECT event_id, value, bad, pos, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER u AS pv, last_value(CASE WHEN NOT bad THEN pos END IGNORE NULLS) OVER u AS pa, first_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN NOT bad THEN pos END IGNORE NULLS) OVER f AS na FROM e
 WINDOW u AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN NOT bad THEN value WHEN pa IS NULL THEN nv WHEN na IS NULL THEN pv WHEN pos - pa < na - pos THEN pv WHEN na - pos < pos - pa THEN nv ELSE greatest(pv, nv) END AS filled FROM x""")
def bidir_fill(spark, d):
    """Values of error events from the nearest other event of the user, the larger of two equally near."""
    e = events(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    return windows.nearest_filled(e, ["user_id"], "pos", "value", F.col("event_type") == "error").select("event_id", "filled")


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn = 1""")
def dominant_value(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return windows.first_wins(g, ["user_id"], [F.desc("n"), "event_type"])


@query(f"""WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS us FROM events)
SELECT event_id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = a.event_type AND b.event_id <> a.event_id AND abs(a.us - b.us) <= 1800 * {US}::BIGINT AND abs(a.value - b.value) <= 50)""")
def band_isolated(spark, d):
    """Events without another of their type near in time and value: an anti join on what has company."""
    e = events(spark, d).select("event_id", "event_type", "value", "us")
    return joins.without_near(e, "event_id", ["event_type"], "us", 1800 * US, "value", 50.0).select("event_id")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_last20 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY event_type""")
def last20_avg(spark, d):
    x = windows.last_n(events(spark, d), ["event_type"], [F.desc("us"), F.desc("event_id")], 20)
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_last20"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10, -1) AS k_mod, json_extract_string(props, '$.a.b') AS missing FROM events""")
def json_dig(spark, d):
    """Dotted paths into JSON; what is missing is null."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(k % 10, F.lit(-1)).alias("k_mod"), F.get_json_object("props", "$.a.b").alias("missing"))


@query("""WITH b AS (SELECT event_type, value, floor(value / 16) * 16 AS bucket FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, bucket, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, bucket) AS rn FROM b GROUP BY event_type, bucket)
SELECT b.event_type, m.bucket, count(*) AS n, round(median(b.value), 6) AS median_near FROM b JOIN m ON m.event_type = b.event_type AND rn = 1 AND abs(b.value - (m.bucket + 8)) <= 24 GROUP BY b.event_type, m.bucket""")
def bucket_mode_median(spark, d):
    """The commonest bucket of 16, and the median of the values near it: counts by narrow ranges tell which ranges hold the middle ones, and only their values are ranked."""
    b = table(spark, d, "events").filter("value is not null").select("event_type", "value", (F.floor(F.col("value") / 16) * 16).cast("double").alias("bucket"))
    m = windows.first_wins(b.groupBy("event_type", "bucket").count(), ["event_type"], [F.desc("count"), "bucket"]).select("event_type", F.col("bucket").alias("mode"))
    near = b.join(m, "event_type").filter(F.abs(F.col("value") - (F.col("mode") + 8)) <= 24).withColumn("part", F.floor(F.col("value") * 64))
    sizes = near.groupBy("event_type", "mode", "part").count()
    w = Window.partitionBy("event_type").orderBy("part")
    sizes = sizes.withColumns({"before": F.sum("count").over(w) - F.col("count"), "n": F.sum("count").over(Window.partitionBy("event_type"))})
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("count"))
    middle = near.select("event_type", "part", "value").join(sizes.filter(holds(low) | holds(high)), ["event_type", "part"])
    at = F.col("before") + F.row_number().over(Window.partitionBy("event_type", "part").orderBy("value")) - 1
    middle = middle.withColumn("at", at).filter((F.col("at") == low) | (F.col("at") == high))
    return middle.groupBy("event_type", F.col("mode").alias("bucket")).agg(F.max("n").alias("n"), F.round(F.avg("value"), 6).alias("median_near"))


@query("""WITH h AS (SELECT event_type AS t, floor(value / 10)::BIGINT AS b, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT t FROM h), b AS (SELECT DISTINCT b FROM h),
f AS (SELECT t.t, b.b, coalesce(h.n, 0) AS n FROM t CROSS JOIN b LEFT JOIN h ON h.t = t.t AND h.b = b.b)
SELECT x.t AS left_type, y.t AS right_type, round(corr(x.n, y.n), 6) AS correlation FROM f x JOIN f y ON x.b = y.b AND x.t < y.t GROUP BY ALL""")
def hist_corr(spark, d):
    """Correlation of the types' value histograms, over bins that any type has, from sums of products; bins that a type lacks count 0."""
    h = stash(table(spark, d, "events").filter("value is not null").groupBy("event_type", F.floor(F.col("value") / 10).alias("b")).agg(F.count("*").cast("double").alias("n")), "histograms")
    bins = h.select(F.countDistinct("b").alias("bins"), F.sort_array(F.collect_set("event_type")).alias("kinds"), F.lit(1).alias("one"))
    sums = h.groupBy("event_type").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).withColumn("one", F.lit(1))
    left = sums.join(bins, "one").withColumn("right_type", F.explode("kinds")).filter(F.col("event_type") < F.col("right_type")).select(F.col("event_type").alias("left_type"), "right_type", F.col("s").alias("s1"), F.col("q").alias("q1"), "bins")
    pairs = left.join(sums.select(F.col("event_type").alias("right_type"), F.col("s").alias("s2"), F.col("q").alias("q2")), "right_type")
    x, y = (h.select("b", F.col("event_type").alias(f"{side}_type"), F.col("n").alias(f"{side}_n")) for side in ("left", "right"))
    both = x.join(y, "b").filter("left_type < right_type").groupBy("left_type", "right_type").agg(F.sum(F.col("left_n") * F.col("right_n")).alias("p"))
    c = pairs.join(both, ["left_type", "right_type"], "left")
    spread = lambda k: F.col("bins") * F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}")
    r = (F.col("bins") * F.coalesce("p", F.lit(0.0)) - F.col("s1") * F.col("s2")) / F.sqrt(spread(1) * spread(2))
    return c.filter((spread(1) > 0) & (spread(2) > 0)).select("left_type", "right_type", F.round(r, 6).alias("correlation"))


@query(f"""WITH w AS (SELECT user_id, value, unnest([(epoch_us(ts) // (3600 * {US}::BIGINT)) - 1, epoch_us(ts) // (3600 * {US}::BIGINT)]) AS hour FROM events),
m AS (SELECT hour, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY hour HAVING count(*) >= 3)
SELECT hour, n, mean FROM m ORDER BY mean DESC, hour LIMIT 3""")
def hop_windows_topk(spark, d):
    """Two-hour windows an hour apart; the three of the largest mean (the feature is a top three)."""
    hour = F.floor(F.col("us") / F.lit(3600 * US).cast("long"))
    w = events(spark, d).select("value", F.explode(F.array(hour - 1, hour)).alias("hour"))
    m = w.groupBy("hour").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).filter("n >= 3")
    return m.orderBy(F.desc("mean"), "hour").limit(3)


@query("""SELECT user_id, max(v) AS top, list_sort(list(v))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS p90, list_sort(list(v))[CAST(floor(0.08 * (count(*) - 1)) AS BIGINT) + 1] AS p8 FROM (SELECT user_id, value AS v FROM events WHERE value IS NOT NULL) GROUP BY user_id""")
def percentiles(spark, d):
    """Lower percentiles of a user's values, which are real values: ranked, not collected."""
    v = table(spark, d, "events").filter("value is not null").select("user_id", "value")
    v = v.withColumns({"n": F.count("*").over(Window.partitionBy("user_id")), "at": F.row_number().over(Window.partitionBy("user_id").orderBy("value")) - 1})
    at = lambda q: F.max(F.when(F.col("at") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col("value")))
    return v.groupBy("user_id").agg(F.max("value").alias("top"), at(0.9).alias("p90"), at(0.08).alias("p8"))


@query()
def rate_limit(spark, d):
    """Admission by a sliding window that holds admitted events only: a fold in order of time, by user."""
    return limiter.admitted(events(spark, d).select("event_id", "user_id", "us"), "user_id", "us", "event_id", limit=3, window=24 * 3600 * US)


@query()
def running_mean_rows(spark, d):
    e = table(spark, d, "events").filter("value is not null").select("event_id", "user_id", "value")
    return graph.running_mean_rows(e, "user_id", "value", "event_id", 8.0)


@query()
def capped_union(spark, d):
    e = table(spark, d, "events").filter("value is not null").select("event_id", "user_id", "value")
    return graph.capped_union(e, "user_id", "value", "event_id", reach=6.0, ratio=1.6)


@query()
def leader_cluster(spark, d):
    e = table(spark, d, "events").filter("value is not null").select("event_id", "user_id", "value")
    return graph.leader_cluster(e, "user_id", "value", "event_id", reach=25.0)


@query("""SELECT user_id, event_id, greatest(0, max(event_id % 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS max_page, least(95, (max(event_id % 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))) AS progress FROM events""")
def running_progress(spark, d):
    """The furthest page so far, and progress capped at 95."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    m = F.max(F.col("event_id") % 100).over(w)
    return events(spark, d).select("user_id", "event_id", F.greatest(F.lit(0), m).alias("max_page"), F.least(F.lit(95), m).alias("progress"))
