"""Queries over orders, lineitem, part and customer: jobs, votes and orders of things."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rounding
from ..operators import windows
from ..session import table
from .registry import query


@query("""WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
f AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT l_suppkey, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY l_suppkey, grp""")
def interval_merge(spark, d):
    """Spans of days from each shipment, merged by supplier across gaps of a day."""
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    s = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"))
    return windows.interval_merge(s, ["l_suppkey"], "a", "b", 1, ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, round((sum(l_quantity) OVER w - l_quantity) / sum(l_quantity) OVER o, 6) AS slice_from, round(sum(l_quantity) OVER w / sum(l_quantity) OVER o, 6) AS slice_to FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY l_orderkey)""")
def cum_slices(spark, d):
    """Each line's part of its order's quantity, as boundaries."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    run, total = F.sum("l_quantity").over(w), F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round((run - F.col("l_quantity")) / total, 6).alias("slice_from"), F.round(run / total, 6).alias("slice_to"))


LADDER = [6, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 36, 40, 44, 48]


@query(f"""SELECT p_partkey, CAST(step AS DOUBLE) AS step FROM (SELECT p_partkey, step, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size * 0.97 - step), step) AS rn FROM part CROSS JOIN (SELECT unnest({LADDER}) AS step)) WHERE rn = 1""")
def snap_ladder(spark, d):
    return table(spark, d, "part").select("p_partkey", rounding.snap(F.col("p_size") * 0.97, LADDER).alias("step"))


@query("""SELECT l_partkey, count(*) AS n, round(CASE WHEN avg(l_quantity) <= 0 THEN 1e308 ELSE stddev_pop(l_quantity) / avg(l_quantity) END, 6) AS cv, coalesce(stddev_pop(l_quantity) / avg(l_quantity) <= 0.5, false) AS steady FROM lineitem GROUP BY l_partkey""")
def cv_gate(spark, d):
    """Population deviation over mean, against a gate. Of whole numbers both are worked out without error from sums, so that neither the order of rows nor the way they are
    dealt decides a part that stands on the gate or half way between two roundings; other numbers take the running formula."""
    q = F.col("l_quantity")
    n, s, squares, mean = F.count(q), F.sum(q), F.sum(q * q), F.avg(q)
    exact = F.bool_and(q % 1 == 0) & (n * squares < 2.0**53)
    cv = F.when(exact, F.sqrt(n * squares - s * s) / F.abs(s)).otherwise(F.stddev_pop(q) / F.abs(mean))
    steady = F.coalesce(F.when(mean < 0, True).when(mean > 0, cv <= 0.5), F.lit(False))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.when(mean <= 0, 1e308).when(mean > 0, cv), 6).alias("cv"), steady.alias("steady"))


@query("""SELECT l_suppkey, floor(median(l_quantity) + 0.5)::BIGINT AS half_up, round(median(l_quantity), 6) AS mean_of_mid, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper, list_sort(list(l_quantity))[(count(*) + 1) // 2] AS lower FROM lineitem GROUP BY l_suppkey""")
def four_medians(spark, d):
    """A supplier's quantities by four medians; from counts of values, so that a group's size does not matter."""
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_suppkey").orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("to", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("l_suppkey")))
    at = lambda k: F.min(F.when(F.col("to") >= k, F.col("l_quantity")))
    g = c.groupBy("l_suppkey").agg(at(F.floor(F.col("n") / 2) + 1).alias("upper"), at(F.floor((F.col("n") + 1) / 2)).alias("lower"))
    mid = (F.col("upper") + F.col("lower")) / 2
    return g.select("l_suppkey", rounding.half_up(mid).alias("half_up"), F.round(mid, 6).alias("mean_of_mid"), "upper", "lower")


@query("""SELECT l_partkey, q AS mode_quantity, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, q DESC) AS rn FROM (SELECT l_partkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rn = 1""")
def mode_tie_max(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_quantity").agg(F.count("*").alias("n"))
    return windows.first_wins(g, ["l_partkey"], [F.desc("n"), F.desc("l_quantity")]).select("l_partkey", F.col("l_quantity").alias("mode_quantity"), "n")


@query("""SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS votes, 2 * count(*) FILTER (WHERE l_returnflag = 'N') >= count(*) AS majority FROM lineitem GROUP BY l_partkey""")
def majority_vote(spark, d):
    v = F.count_if(F.col("l_returnflag") == "N")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), v.alias("votes"), (2 * v >= F.count("*")).alias("majority"))


@query("""WITH j AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS mode, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'queued' END AS status, pages, secs FROM orders JOIN (SELECT l_orderkey, count(*) AS pages, sum(l_quantity) AS secs FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
h AS (SELECT mode, avg(secs / pages) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM j WHERE status = 'done') WHERE rn <= 20 GROUP BY mode)
SELECT o_orderkey, status, (SELECT count(*) FROM j WHERE status = 'running') + row_number() OVER (PARTITION BY status ORDER BY o_orderdate, o_orderkey) - CASE WHEN status = 'running' THEN (SELECT count(*) FROM j WHERE status = 'running') ELSE 0 END - 1 AS ahead, round(pages * coalesce(rate, 60), 6) AS eta_seconds
FROM j LEFT JOIN h USING (mode) WHERE status IN ('running', 'queued')""")
def queue_eta(spark, d):
    """Orders as jobs: how many are ahead in the queue, and seconds to go from the last 20 done of the mode. Places in the queue
    come from counts by day, so no window holds all jobs."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"), F.sum("l_quantity").alias("secs"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    j = table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("mode"), status.alias("status"), "pages", "secs", F.to_date("o_orderdate").alias("day"))
    done = windows.last_n(j.filter("status = 'done'"), ["mode"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 20)
    rate = done.groupBy("mode").agg(F.avg(F.col("secs") / F.col("pages")).alias("rate"))
    live = j.filter("status <> 'done'")
    days = live.groupBy("status", "day").agg(F.count("*").alias("c"))
    days = days.withColumn("before", F.sum("c").over(Window.partitionBy("status").orderBy("day")) - F.col("c"))
    running = days.filter("status = 'running'").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    at = F.row_number().over(Window.partitionBy("status", "day").orderBy("o_orderdate", "o_orderkey"))
    out = live.withColumn("at", at).join(days.select("status", "day", "before"), ["status", "day"]).join(rate, "mode", "left")
    ahead = F.col("before") + F.col("at") - 1 + F.when(F.col("status") == "queued", F.lit(running)).otherwise(0)
    return out.select("o_orderkey", "status", ahead.alias("ahead"), F.round(F.col("pages") * F.coalesce("rate", F.lit(60.0)), 6).alias("eta_seconds"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active, count(*) AS total FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus <> 'F') >= 2""")
def throttle(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("active"), F.count("*").alias("total")).filter("active >= 2")


@query("""SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01') AS age_days FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01'""")
def retention_stale(spark, d):
    cut = F.lit("1996-01-01")
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < cut.cast("timestamp_ntz"))).select("o_orderkey", F.date_diff(cut.cast("date"), F.to_date("o_orderdate")).cast("long").alias("age_days"))


@query("""SELECT 'except' AS op, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS s FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'intersect', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'union', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)""")
def set_algebra(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    sets = {"except": c.subtract(o), "intersect": c.intersect(o), "union": c.union(o).distinct()}
    rows = [x.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("s")).select(F.lit(name).alias("op"), "n", "s") for name, x in sets.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("""SELECT l_orderkey, l_linenumber, role, printf('t%03d', row_number() OVER (PARTITION BY l_orderkey ORDER BY role, l_linenumber, l_partkey, l_suppkey)) AS id FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 1 END AS role FROM lineitem)""")
def role_priority_order(spark, d):
    """Lines by role and number, with dense ids."""
    role = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(1)
    x = table(spark, d, "lineitem").withColumn("role", role)
    return x.select("l_orderkey", "l_linenumber", "role", F.format_string("t%03d", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("role", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"))


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT unnest(range(3, 9)) UNION SELECT 12 UNION SELECT unnest(range(40, 61)))""")
def page_ranges(spark, d):
    """A page list such as 3-8,12,40-60 as a semi join."""
    return pages(table(spark, d, "orders"), "o_orderkey", "3-8,12,40-60").select("o_orderkey", "o_orderstatus", "o_totalprice")


def pages(df, key: str, spec: str):
    """The rows whose key lies in a list of numbers and ranges."""
    s = df.sparkSession.createDataFrame([(spec,)], "spec string").select(F.explode(F.split("spec", ",")).alias("x"))
    ends = F.split("x", "-")
    want = s.select(F.explode(F.sequence(F.get(ends, 0).cast("long"), F.coalesce(F.get(ends, 1), F.get(ends, 0)).cast("long"))).alias(key)).distinct()
    return df.join(want, key, "left_semi")


@query("""SELECT o_custkey, count(*) AS n, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'running' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'queued' ELSE 'done' END AS state, greatest(1, date_diff('day', min(o_orderdate), max(o_orderdate))) AS days FROM orders GROUP BY o_custkey""")
def job_states(spark, d):
    """A customer's state by precedence, and whole days from first to last order, one at least."""
    has = lambda s: F.count_if(F.col("o_orderstatus") == s) > 0
    days = F.date_diff(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate"))).cast("long")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.when(has("P"), "running").when(has("O"), "queued").otherwise("done").alias("state"), F.greatest(F.lit(1).cast("long"), days).alias("days"))


@query("""SELECT l_orderkey, count(*) AS used, max(l_linenumber) AS rows_n, round(count(DISTINCT l_linenumber) / max(l_linenumber), 6) AS fill_ratio, count(DISTINCT l_linenumber) / max(l_linenumber) >= 0.5 AND max(l_linenumber) >= 2 AS accepted FROM lineitem GROUP BY l_orderkey""")
def grid_density(spark, d):
    """How full an order's numbered lines are, against gates."""
    r = F.countDistinct("l_linenumber") / F.max("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("used"), F.max("l_linenumber").alias("rows_n"), F.round(r, 6).alias("fill_ratio"), ((r >= 0.5) & (F.max("l_linenumber") >= 2)).alias("accepted"))
