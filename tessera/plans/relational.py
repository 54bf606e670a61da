"""Queries over the star schema and the events table, with the SQL they are checked against.

Sums are of decimals and every order is total, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.aggregates import check_digits, geometric_mean
from tessera.functions.columns import cosine, gathered_schema, money, sample_skewness, variant_path
from tessera.operators.graphs import reached
from tessera.operators.inequality import inequality_join
from tessera.operators.joins import asof_join, range_join, salted_join
from tessera.operators.windows import exact_percentile, sessionize, stratified_sample, top_k
from tessera.session import ship_package, table, write_shared
from tessera.streaming.events import count_by_window, event_stream, first_seen, run_to_end
from tessera.streaming.sessions import sessions_by_silence, sessions_to_outcome

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_REVENUE = "CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DECIMAL(18,4))"


def _revenue():
    return (money("l_extendedprice") * (1 - money("l_discount"))).cast("decimal(18,4)")


@_query(f"""
    SELECT n_name, CAST(sum({_REVENUE}) AS DOUBLE) AS revenue, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted revenue by the customer's nation."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum(_revenue()).cast("double").alias("revenue"), F.count("*").alias("n_lines"))
    )


@_query(f"""
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity,
           CAST(sum({_REVENUE}) AS DOUBLE) AS revenue, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL HAVING count(*) > 1""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, group, distinct aggregate, having."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(money("l_quantity")).cast("double").alias("quantity"),
            F.sum(_revenue()).cast("double").alias("revenue"),
            F.count("*").alias("n"),
            F.count_distinct("l_suppkey").alias("suppliers"),
        )
        .where("n > 1")
    )


@_query(f"""
    SELECT l_orderkey, CAST(sum({_REVENUE}) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_orderkey
    ORDER BY revenue DESC, l_orderkey LIMIT 20""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty orders of most revenue."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_revenue()).cast("double").alias("revenue"))
    return lines.orderBy(F.desc("revenue"), "l_orderkey").limit(20)


@_query("""
    SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def lines_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g1, g2 = (F.grouping(c).cast("long").alias(a) for c, a in (("l_returnflag", "g1"), ("l_linestatus", "g2")))
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(g1, g2, F.count("*").alias("n"))


@_query("""
    SELECT c_mktsegment, n_regionkey, grouping_id(c_mktsegment, n_regionkey) AS g, count(*) AS n
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)""")
def customers_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.cube("c_mktsegment", "n_regionkey").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@_query("""
    SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def orders_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@_query("""
    SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O
    FROM lineitem GROUP BY l_returnflag""")
def lines_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return counts.fillna(0)


@_query("""
    SELECT s_suppkey, k AS kind, v AS value FROM (
        SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier)
    UNPIVOT (v FOR k IN (nation, balance))""")
def suppliers_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return wide.unpivot("s_suppkey", ["nation", "balance"], "kind", "value")


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@_query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def parts_without_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return table(spark, sf_dir, "part").join(large, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_brand")


@_query("""
    SELECT coalesce(c.k, s.k) AS nationkey, c.n AS customers, s.n AS suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k""")
def nations_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "full")


@_query("""
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE CAST(o_totalprice AS DECIMAL(18,4)) * (SELECT count(*) FROM orders i WHERE i.o_custkey = o.o_custkey)
          > 2 * (SELECT sum(CAST(o_totalprice AS DECIMAL(18,4))) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def orders_above_twice_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated subquery as an aggregate and a join on its key."""
    orders = table(spark, sf_dir, "orders")
    own = orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("total"), F.count("*").alias("n"))
    return orders.join(own, "o_custkey").where(money("o_totalprice") * F.col("n") > 2 * F.col("total")).select("o_orderkey", "o_custkey")


@_query("""
    SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER t AS q, cume_dist() OVER w AS c
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def orders_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, t = W.partitionBy("o_custkey").orderBy("o_orderpriority"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranks = [F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(t).cast("long").alias("q"), F.cume_dist().over(w).alias("c")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *ranks)


@_query("""
    SELECT event_id, lag(v IGNORE NULLS) OVER w AS before, lead(value) OVER w AS after FROM (
        SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def events_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    last = F.last(bought, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return table(spark, sf_dir, "events").select("event_id", last.alias("before"), F.lead("value").over(w).alias("after"))


@_query("""
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n
    FROM events""")
def events_rolling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.expr("count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
    return table(spark, sf_dir, "events").select("event_id", w.alias("n"))


@_query("""
    SELECT p.event_id, v.event_id AS asof_seen, v.value AS asof_worth
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def purchases_asof_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before each purchase."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"), F.col("value").alias("worth"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, views, "user_id", "ts", "ts", ["seen", "worth"]).select("event_id", "asof_seen", "asof_worth")


@_query("""
    SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 20""")
def parts_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join without an equal key."""
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    points = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return range_join(points, ranges, "p_retailprice", "low", "high", 20.0).select("p_partkey", "s_suppkey")


@_query("""
    SELECT user_id, session, count(*) AS n, min(ts) AS began FROM (
        SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
            SELECT *, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) > 1800 IS NOT FALSE THEN 1 ELSE 0 END AS new FROM events))
    GROUP BY ALL""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = sessionize(table(spark, sf_dir, "events"), "user_id", "ts", 1800)
    return sessions.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"))


_DAILY = "SELECT date_trunc('day', ts) AS began, event_type, count(*) AS n FROM events GROUP BY ALL"


@_query(_DAILY)
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_by_window(table(spark, sf_dir, "events"), "1 day")
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


@_query(_DAILY)
def events_tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream."""
    counts = run_to_end(count_by_window(event_stream(spark, sf_dir), "1 day"), "complete")
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


@_query("""
    SELECT w AS began, count(*) AS n FROM (
        SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY w""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("began"), "n")


@_query("""
    SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank
    FROM customer QUALIFY rank <= 3""")
def richest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return top_k(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).withColumn("rank", F.col("rank").cast("long"))


@_query("""
    (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
    UNION ALL (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
    UNION ALL (SELECT n_nationkey FROM nation UNION SELECT r_regionkey FROM region)""")
def nation_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    return c.exceptAll(s).unionByName(c.intersectAll(s)).unionByName(n.union(r).distinct())


@_query("""
    WITH RECURSIVE t(level, nations) AS (
        SELECT 1, CAST(count(*) AS BIGINT) FROM nation UNION ALL SELECT level + 1, nations * 2 FROM t WHERE level < 8)
    SELECT level, nations FROM t""")
def recursive_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "WITH RECURSIVE t(level, nations) AS (SELECT 1, count(*) FROM {n} UNION ALL SELECT level + 1, nations * 2 FROM t WHERE level < 8) SELECT level, nations FROM t",
        n=table(spark, sf_dir, "nation"),
    )


@_query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def events_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@_query("""
    SELECT p_partkey, md5(p_name) AS digest, split_part(p_brand, '#', 2) AS number, len(string_split(p_type, ' ')) AS words,
           regexp_replace(p_type, '[AEIOU]', '', 'g') AS bare, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size FROM part""")
def part_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.md5("p_name").alias("digest"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("number"),
        F.size(F.split("p_type", " ")).cast("long").alias("words"),
        F.regexp_replace("p_type", "[AEIOU]", "").alias("bare"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size"),
    )


@_query("""
    SELECT date_trunc('month', o_orderdate) AS month, dayofweek(o_orderdate) + 1 AS weekday, count(*) AS n,
           max(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')) AS oldest FROM orders GROUP BY 1, 2""")
def orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").groupBy(month, F.dayofweek("o_orderdate").cast("long").alias("weekday")).agg(F.count("*").alias("n"), F.max(age).cast("long").alias("oldest"))


@_query("""
    SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[])
           / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(f.embedding::DOUBLE[], f.embedding::DOUBLE[]))), 6) AS cosine
    FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) f USING (label)""")
def cosine_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cosine with the first of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


@_query("""
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
           round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, median(l_quantity) AS middle, quantile_cont(l_extendedprice, 0.9) AS high,
           round(skewness(l_extendedprice), 6) AS skew, round(kurtosis_pop(l_quantity), 6) AS tails
    FROM lineitem GROUP BY l_returnflag""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    moments = lines.groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("deviation"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(sample_skewness("l_extendedprice"), 6).alias("skew"),
        F.round(F.kurtosis("l_quantity"), 6).alias("tails"),
    )
    middle = exact_percentile(lines, "l_returnflag", "l_quantity", 0.5).withColumnRenamed("percentile", "middle")
    high = exact_percentile(lines, "l_returnflag", "l_extendedprice", 0.9).withColumnRenamed("percentile", "high")
    return moments.join(middle, "l_returnflag").join(high, "l_returnflag")


@_query("""
    SELECT v.event_id AS seen, p.event_id AS bought FROM events v JOIN events p
    ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND v.value >= p.value AND v.value < p.value + 5""")
def views_priced_like_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join within an equal key."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("seen"), "value")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("value").alias("low"), (F.col("value") + 5).alias("high"))
    return range_join(views, bought, "value", "low", "high", 5.0, ["user_id"]).select("seen", "bought")


@_query("SELECT event_id, event_type FROM events")
def events_once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, of a stream that delivers them twice."""
    stream = event_stream(spark, sf_dir)
    return run_to_end(first_seen(stream.unionByName(event_stream(spark, sf_dir))), "append").select("event_id", "event_type")


@_query("""
    WITH marked AS (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS new FROM events),
    numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM numbered GROUP BY user_id, session
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of a stream: those that are over by its watermark, an hour before its last event."""
    found = run_to_end(sessions_by_silence(event_stream(spark, sf_dir), "user_id", "ts", "30 minutes"), "append")
    return found.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@_query("""
    WITH marked AS (
        SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(event_type) OVER w = 'purchase', true) AS new
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked),
    whole AS (SELECT user_id, min(ts) AS began, max(ts) AS last, count(*) AS n, bool_or(event_type = 'purchase') AS by_outcome FROM numbered GROUP BY user_id, session)
    SELECT * FROM whole WHERE last + CASE WHEN by_outcome THEN INTERVAL 0 MINUTE ELSE INTERVAL 30 MINUTE END <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def purchase_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream that a purchase or silence has ended, by state and timers of their own."""
    stream = event_stream(spark, sf_dir)
    found = run_to_end(sessions_to_outcome(stream, "user_id", "ts", "event_type", "event_id", 1800, "purchase"), "append", rocksdb=True)
    return found.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("last").cast("timestamp_ntz").alias("last"), "n", "by_outcome")


@_query("""
    WITH marked AS (
        SELECT *, coalesce(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) > 1800, true) AS new
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked),
    sessions AS (SELECT user_id, min(ts) AS began, max(ts) AS ended FROM numbered GROUP BY user_id, session)
    SELECT x.user_id AS a_user, x.began AS a_began, y.user_id AS b_user, y.began AS b_began
    FROM sessions x JOIN sessions y ON x.began < y.ended AND x.ended > y.began AND x.user_id < y.user_id""")
def sessions_at_one_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users' sessions that overlap: a join on two inequalities."""
    sessions = sessionize(table(spark, sf_dir, "events"), "user_id", "ts", 1800).groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    sessions = write_shared(sessions.drop("session"), "sessions")  # both sides of the join
    a, b = (sessions.select(F.col("user_id").alias(f"{x}_user"), F.col("began").alias(f"{x}_began"), F.col("ended").alias(f"{x}_ended")) for x in "ab")
    columns = ["a_user", "a_began", "b_user", "b_began"]
    return inequality_join(a, b, ("a_began", "<", "b_ended"), ("a_ended", ">", "b_began"), also=("a_user", "<", "b_user"), columns=columns)


@_query("""
    SELECT o_orderkey, l_partkey, l_suppkey, l_extendedprice FROM orders, LATERAL (
        SELECT l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey
        ORDER BY l_extendedprice DESC, l_partkey, l_suppkey LIMIT 3) WHERE o_totalprice > 100000""")
def largest_lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest lines of each large order: a subquery that is correlated with every row, which Catalyst turns into a join and a rank."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") == F.col("o_orderkey").outer())
    lines = lines.orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey").limit(3)
    return orders.lateralJoin(lines.select("l_partkey", "l_suppkey", "l_extendedprice"))


@_query("""
    WITH RECURSIVE bought AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 48),
    shared AS (SELECT DISTINCT x.c AS a, y.c AS b FROM bought x JOIN bought y ON x.p = y.p AND x.c <> y.c),
    reach(c, steps) AS (
        SELECT min(c), 0 FROM bought UNION
        SELECT b, steps + 1 FROM reach JOIN shared ON reach.c = a WHERE steps < 4)
    SELECT c AS custkey, min(steps)::BIGINT AS steps FROM reach GROUP BY c""")
def customers_reached_over_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within four steps of the first one; a step leads to who bought much of the same part. Parts are nodes between
    customers, so no pairs of a part's buyers are made."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select("l_orderkey", "l_partkey")
    bought = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = write_shared(bought.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct(), "bought")
    edges = bought.unionByName(bought.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = reached(bought.agg(F.min("src").alias("node")), edges, 8).where("node % 2 = 0")
    return found.select((F.col("node") / 2).cast("long").alias("custkey"), (F.col("steps") / 2).cast("long").alias("steps"))


@_query("""
    SELECT l_returnflag, n_both, true AS sketch_is_near FROM (
        SELECT l_returnflag, count(DISTINCT l_partkey) AS n_both FROM lineitem x
        WHERE EXISTS (SELECT 1 FROM lineitem y WHERE y.l_partkey = x.l_partkey AND y.l_returnflag <> x.l_returnflag AND y.l_quantity > 40) GROUP BY 1)""")
def parts_in_several_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each flag that also have a large line of another one: exact, and whether theta sketches, united over the other
    flags and intersected with the flag's own, are within a tenth of all parts of it."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_quantity")
    own = lines.select("l_returnflag", "l_partkey").distinct()
    large = lines.where("l_quantity > 40").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("flags"))  # a few flags
    other = F.size(F.array_remove("flags", F.col("l_returnflag"))) > 0
    exact = own.join(large, "l_partkey", "left").groupBy("l_returnflag").agg(F.count_if(other).alias("n_both"), F.count("*").alias("n"))
    sketches = lines.groupBy("l_returnflag").agg(F.theta_sketch_agg("l_partkey").alias("own"), F.theta_sketch_agg(F.when(F.col("l_quantity") > 40, F.col("l_partkey"))).alias("large"))
    every = F.collect_list(F.struct("l_returnflag", "large")).over(W.partitionBy(F.lit(0)))  # a row for each flag
    rest = F.filter("every", lambda x: x["l_returnflag"] != F.col("l_returnflag"))
    united = F.aggregate(rest, F.lit(None).cast("binary"), lambda acc, x: F.coalesce(F.theta_union(acc, x["large"]), x["large"]))
    about = sketches.withColumn("every", every).select("l_returnflag", F.theta_sketch_estimate(F.theta_intersection("own", united)).alias("about"))
    near = F.abs(F.col("about") - F.col("n_both")) <= F.col("n") * 0.1 + 2
    return exact.join(about, "l_returnflag").where("n_both > 0").select("l_returnflag", "n_both", near.alias("sketch_is_near"))


@_query("""
    SELECT o_orderpriority, o_orderkey FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS k FROM orders) WHERE k <= 50""")
def orders_sampled_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders of each priority: an exact stratified sample, by the smallest digests of keys."""
    return stratified_sample(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", 50).select("o_orderpriority", "o_orderkey")


@_query("""
    SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, (SELECT 'OBJECT<k: BIGINT>') AS kind
    FROM events GROUP BY 1, 2""")
def events_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a typed path of their semi-structured properties, and the schema of all of these."""
    events = table(spark, sf_dir, "events").select("event_type", "props")
    counts = events.groupBy("event_type", variant_path("props", "$.k", "bigint").alias("k")).agg(F.count("*").alias("n"))
    return counts.withColumn("kind", F.lit(gathered_schema(events, "props")))


@_query("""
    SELECT s_nationkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def lines_by_suppliers_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join in which each supplier's lines are dealt to eight tasks, by order, as for suppliers that hold a large share of lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey")
    joined = salted_join(lines, table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"], 8, F.col("l_orderkey"))
    return joined.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_distinct("s_suppkey").alias("suppliers"))


@_query("SELECT l_suppkey, round(exp(sum(l_quantity * ln(l_extendedprice)) / sum(l_quantity)), 4) AS mean FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def geometric_mean_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of the library's own: a geometric mean of prices, weighted by quantity, for each supplier."""
    lines = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    return geometric_mean(lines, "l_suppkey", "l_extendedprice", "l_quantity").select("l_suppkey", F.round("mean", 4).alias("mean"))


@_query("SELECT o_orderkey, 98 - o_orderkey * 100 % 97 AS digits FROM orders")
def order_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function of the library's own over every order's key."""
    ship_package(spark)
    return table(spark, sf_dir, "orders").select("o_orderkey", check_digits("o_orderkey").alias("digits"))


@_query("SELECT year(l_shipdate) AS year, count(DISTINCT l_partkey) AS parts, true AS sketch_is_near FROM lineitem GROUP BY 1")
def distinct_parts_and_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, and whether the merged sketches are within a tenth of them."""
    exact = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.count_distinct("l_partkey").alias("parts"))
    sketches = approximate_parts(spark, sf_dir).select("year", F.col("parts").alias("about"))
    near = F.abs(F.col("about") - F.col("parts")) <= F.col("parts") * 0.1 + 2
    return exact.join(sketches, "year").select("year", "parts", near.alias("sketch_is_near"))


@_query(None)
def approximate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts by ship year from sketches that merge; approximate, so without an equal in SQL."""
    year = F.year("l_shipdate").alias("year")
    sketches = table(spark, sf_dir, "lineitem").groupBy(year, "l_returnflag").agg(F.hll_sketch_agg("l_partkey").alias("s"))
    return sketches.groupBy("year").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("parts"))
