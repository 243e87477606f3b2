"""Queries of the survey's operators over the driver's tables, each with its oracle. Names begin with the survey's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import intervals, ranking, sequences, stats, vectors
from tessera.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str):
    def put(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return put


@query("s03_keyset_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def s03(spark: SparkSession, d: str) -> DataFrame:
    """A page after a key; the limit is the feature."""
    return table(spark, d, "orders").where("o_orderkey > 1000").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("s05_json_column", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s05(spark, d):
    """A JSON column read with a schema; what doesn't parse is null."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("f15_soft_filter", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS hit FROM orders)
  WHERE o_totalprice >= 100000 OR hit = 0""")
def f15(spark, d):
    """The predicate holds in a group unless it would empty it."""
    passed = F.col("o_totalprice") >= 100000
    hit = F.max(passed.cast("int")).over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").withColumn("hit", hit).where(passed | (F.col("hit") == 0)).select("o_custkey", "o_orderkey", "o_totalprice")


@query("f16_tiers", """SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 1 WHEN p_type LIKE '%STEEL%' THEN 2 ELSE 3 END AS tier FROM part
  WHERE p_brand = 'Brand#13' OR p_type LIKE '%STEEL%' OR p_retailprice >= 0.22 * (SELECT max(p_retailprice) FROM part)""")
def f16(spark, d):
    """Exact, semantic and loose matches; the loose tier follows the best score."""
    part = table(spark, d, "part")
    best = part.agg((F.max("p_retailprice") * 0.22).alias("least"))  # one row
    tier = F.when(F.col("p_brand") == "Brand#13", 1).when(F.col("p_type").contains("STEEL"), 2).otherwise(3)
    return part.crossJoin(F.broadcast(best)).withColumn("tier", tier).where((F.col("tier") < 3) | (F.col("p_retailprice") >= F.col("least"))).select("p_partkey", "tier")


@query("f19_silent_gates", "SELECT user_id, count(*) AS asked FROM events GROUP BY user_id HAVING count(*) >= 20 AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0")
def f19(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("event_type") == "error").alias("fired"))
    return by.where("asked >= 20 AND fired = 0").select("user_id", "asked")


@query("j01_left_join", "SELECT c.c_custkey, c.c_name, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0")
def j01(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").where("c_acctbal > 0").join(nation, "c_nationkey", "left").select("c_custkey", "c_name", "n_name")


@query("j02_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j02(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j04_semi_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def j04(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(returned, "s_suppkey", "left_semi").select("s_suppkey")


@query("j07_lookup_default", "SELECT event_type, sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 ELSE 1 END) AS points FROM events GROUP BY event_type")
def j07(spark, d):
    """A literal relation with a default."""
    points = F.create_map(F.lit("purchase"), F.lit(5), F.lit("signup"), F.lit(3))
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(F.try_element_at(points, "event_type"), F.lit(1))).alias("points"))


@query("j10_similarity_topk", """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  p AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_dot_product(q.e, b.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS place FROM p) SELECT query_id, vec_id, similarity, place FROM r WHERE place <= 5""")
def j10(spark, d):
    """Cosine top-5 of every hundredth vector (the stated query set) against all."""
    rows = table(spark, d, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0"), 5)


_SPANS = "SELECT o_orderkey AS id, o_custkey, epoch(o_orderdate) / 86400 AS start, epoch(o_orderdate) / 86400 + 1 + o_orderkey % 30 AS \"end\" FROM orders"


def spans(spark, d):
    start = F.unix_timestamp("o_orderdate") / 86400
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", start.alias("start"), (start + 1 + F.col("o_orderkey") % 30).alias("end"))


@query("j12_interval_overlap", f"WITH s AS ({_SPANS}) SELECT a.o_custkey, a.id AS left_id, b.id AS right_id, round(least(a.\"end\", b.\"end\") - greatest(a.start, b.start), 6) AS overlap FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.id < b.id AND a.start < b.\"end\" AND b.start < a.\"end\"")
def j12(spark, d):
    """Orders of a customer whose handling spans overlap."""
    s = spans(spark, d)
    return intervals.overlaps(s, s, "o_custkey", 30.0).where("left_id < right_id").withColumn("overlap", F.round("overlap", 6))


@query("a03_conditional_counts", "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS rest FROM orders GROUP BY o_custkey")
def a03(spark, d):
    counts = [F.count_if(F.col("o_orderstatus") == v).alias(n) for v, n in (("F", "done"), ("O", "open"))]
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), *counts)
    return by.withColumn("rest", F.expr("total - done - open"))


@query("a04_closed_histogram", "SELECT d.event_type, count(e.event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) d(event_type) LEFT JOIN events e USING (event_type) GROUP BY d.event_type")
def a04(spark, d):
    """Classes without rows count 0."""
    domain = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "refund", "signup", "view")], "event_type string")
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("event_id").alias("n"))
    return domain.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("a06_frequency_top", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def a06(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("a10_health_score", """SELECT l_suppkey, round(greatest(0, least(100, 40 * avg(1 - l_discount) + 30 * avg(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) + 30 * avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END))), 4) AS health FROM lineitem GROUP BY l_suppkey""")
def a10(spark, d):
    """A weighted composite, clamped to 0 to 100."""
    score = 40 * F.avg(1 - F.col("l_discount")) + 30 * F.avg((F.col("l_returnflag") != "R").cast("int")) + 30 * F.avg((F.col("l_linestatus") == "F").cast("int"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 4).alias("health"))


@query("a18_spread", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / avg(value) END, 6) AS cv FROM events GROUP BY event_type")
def a18(spark, d):
    return stats.spread(table(spark, d, "events"), "event_type", "value")


@query("a19_entropy", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), p AS (SELECT n / (SELECT sum(n) FROM c) AS p FROM c) SELECT count(*) AS classes, round(-sum(p * log2(p)) / log2(greatest(2, count(*))), 6) AS entropy FROM p")
def a19(spark, d):
    return stats.normalised_entropy(table(spark, d, "part"), "p_brand")


@query("a20_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, event_type AS mode, n FROM r WHERE k = 1")
def a20(spark, d):
    return stats.mode_first_seen(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("a22_repeated_sources", "SELECT text, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(DISTINCT source) >= 2")
def a22(spark, d):
    """Texts are grouped by their digests; only those that several sources have are read again."""
    docs = table(spark, d, "documents")
    by = docs.groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.count_distinct("source").alias("sources"), F.min("doc_id").alias("doc_id")).where("sources >= 2")
    return by.join(docs.select("doc_id", "text"), "doc_id").select("text", "sources")


@query("a27_min_max", "SELECT p_partkey, round(CASE WHEN p_retailprice IS NULL THEN 0 WHEN h = l THEN 1 ELSE (p_retailprice - l) / (h - l) END, 6) AS scaled FROM part, (SELECT min(p_retailprice) AS l, max(p_retailprice) AS h FROM part)")
def a27(spark, d):
    part = table(spark, d, "part")
    ends = part.agg(F.min("p_retailprice").alias("l"), F.max("p_retailprice").alias("h"))  # one row
    return part.crossJoin(F.broadcast(ends)).select("p_partkey", F.round(stats.min_max(F.col("p_retailprice"), F.col("l"), F.col("h")), 6).alias("scaled"))


@query("a32_daily_spend", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def a32(spark, d):
    """Integer cents, rounded for each call."""
    rows = table(spark, d, "events").where("event_type = 'purchase'")
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("a42_repeated_keys", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1] AS first_order, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 3")
def a42(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_order"), F.count(F.lit(1)).alias("n")).where("n > 3").drop("o_orderpriority")


@query("w01_queue_position", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'")
def w01(spark, d):
    """The place of an open order in its customer's queue."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", place.alias("position"))


@query("w03_rolling", """SELECT event_id, user_id, n, round(a, 6) AS avg, round(CASE WHEN a = 0 THEN 0 ELSE s / a END, 6) AS cv, n >= 3 AND round(CASE WHEN a = 0 THEN 0 ELSE s / a END, 6) < 0.35 AS reliable FROM
  (SELECT event_id, user_id, count(value) OVER w AS n, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""")
def w03(spark, d):
    return stats.rolling(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "n", "avg", "cv", "reliable")


@query("w04_runs", """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM b GROUP BY user_id, run""")
def w04(spark, d):
    """Runs compose over hours, and are numbered by hours."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    first = sequences.in_runs(rows, "user_id", "hour", ["ts", "event_id"], "event_type").where("before = 0")
    return sequences.numbered(first, ["user_id"], "hour", ["ts", "event_id"], "run").select("user_id", "run", "event_type", F.col("run_length").alias("length"))


@query("w04_run_penalties", """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR event_type = 'error' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM b)
  SELECT user_id, max(place) AS longest, 4 * count(*) FILTER (place >= 3) AS penalty FROM c GROUP BY user_id""")
def w04_penalties(spark, d):
    """The longest run, and 4 points for each row from a run's third on; an unknown kind (here 'error') makes no run."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    place = F.when(F.col("event_type") == "error", 1).otherwise(F.col("before") + 1)
    places = sequences.in_runs(rows, "user_id", "hour", ["ts", "event_id"], "event_type").select("user_id", place.alias("place"))
    return places.groupBy("user_id").agg(F.max("place").alias("longest"), (4 * F.count_if(F.col("place") >= 3)).alias("penalty"))


@query("w05_longest_run", """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT user_id, run, count(*) AS n FROM b GROUP BY user_id, run) SELECT user_id, max(n) AS longest, count(*) FILTER (n >= 3) AS of_three FROM c GROUP BY user_id""")
def w05(spark, d):
    """The longest run, and how many reached three."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    runs = sequences.in_runs(rows, "user_id", "hour", ["ts", "event_id"], "event_type").where("before = 0")
    return runs.groupBy("user_id").agg(F.max("run_length").alias("longest"), F.count_if(F.col("run_length") >= 3).alias("of_three"))


@query("w08_latest_per_group", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events) WHERE place <= 3")
def w08(spark, d):
    return stats.latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "place")


@query("w16_cumulative", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w - l_quantity, 4) AS start, round(sum(l_quantity) OVER w, 4) AS stop FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def w16(spark, d):
    stop = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(stop - F.col("l_quantity"), 4).alias("start"), F.round(stop, 4).alias("stop"))


@query("r01_weighted_rank", """WITH s AS (SELECT p_partkey, p_size / 50.0 AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / 2500 END AS b, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 11) / 10.0 END AS c FROM part)
  SELECT p_partkey, round((coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2) / (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6) AS score FROM s""")
def r01(spark, d):
    """Missing signals give their weight to the others."""
    key = F.col("p_partkey")
    signals = {
        "size": (F.col("p_size") / 50.0, 0.5),
        "price": (F.when(key % 3 != 0, F.col("p_retailprice") / 2500), 0.3),
        "other": (F.when(key % 5 != 0, (key % 11) / 10.0), 0.2),
    }
    return table(spark, d, "part").select("p_partkey", F.round(ranking.weighted(signals), 6).alias("score"))


@query("r06_confidence_tiers", "SELECT p_partkey, CASE WHEN s >= 85 THEN 'high' WHEN s >= 70 THEN 'medium' WHEN s >= 50 THEN 'low' ELSE 'none' END AS tier FROM (SELECT p_partkey, p_size * 2 AS s FROM part)")
def r06(spark, d):
    return table(spark, d, "part").select("p_partkey", ranking.tier(F.col("p_size") * 2).alias("tier"))


@query("r07_winner", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def r07(spark, d):
    order = [F.desc("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")]
    return ranking.winners(table(spark, d, "orders"), "o_custkey", order).select("o_custkey", "o_orderkey")


@query("r10_capped_topk", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), b AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM a WHERE k <= 2)
  SELECT o_custkey, o_orderkey, place FROM b WHERE place <= 5""")
def r10(spark, d):
    return ranking.capped_top(table(spark, d, "orders"), "o_custkey", "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 5).select("o_custkey", "o_orderkey", "place")


@query("r31_largest_remainder", """WITH c AS (SELECT event_type, count(*) AS w FROM events GROUP BY event_type), q AS (SELECT event_type, w * 37 / (sum(w) OVER ()) AS q FROM c), f AS (SELECT *, CAST(floor(q) AS BIGINT) AS f FROM q),
  r AS (SELECT *, 37 - sum(f) OVER () AS l, row_number() OVER (ORDER BY round(q - f, 9) DESC, event_type) AS k FROM f) SELECT event_type, CAST(f + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS seats FROM r""")
def r31(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("w"))
    return ranking.apportion(counts, "w", "event_type", 37)


@query("d05_content_dedup", "SELECT substr(sha256(coalesce(text, '')), 1, 24) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def d05(spark, d):
    hash_ = F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 24).alias("hash")
    return table(spark, d, "documents").groupBy(hash_).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("d09_merge_cuts", """WITH RECURSIVE o AS (SELECT o_custkey, epoch(o_orderdate) / 86400 AS t FROM orders), g AS (SELECT o_custkey, min(t) AS t FROM o GROUP BY o_custkey UNION ALL
  SELECT g.o_custkey, (SELECT min(o.t) FROM o WHERE o.o_custkey = g.o_custkey AND o.t - g.t >= 60) FROM g WHERE g.t IS NOT NULL) SELECT o_custkey, count(t) AS kept FROM g GROUP BY o_custkey""")
def d09(spark, d):
    """Cuts that lie 60 days or more after the last one kept."""
    cuts = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.unix_timestamp("o_orderdate") / 86400).alias("cuts"))
    return cuts.select("o_custkey", F.size(intervals.merge_cuts(F.col("cuts"), 60.0)).cast("long").alias("kept"))


@query("d13_split_ranges", f"""WITH s AS ({_SPANS}), n AS (SELECT *, greatest(CAST(ceil(("end" - start) / 10) AS BIGINT), 1) AS n FROM s), p AS (SELECT *, unnest(range(1, n + 1)) AS part FROM n)
  SELECT id, part, round(start + ("end" - start) / n * (part - 1), 6) AS part_start, round(start + ("end" - start) / n * part, 6) AS part_end FROM p""")
def d13(spark, d):
    return intervals.split(spans(spark, d), "start", "end", 10.0).select("id", "part", F.round("part_start", 6).alias("part_start"), F.round("part_end", 6).alias("part_end"))


@query("m01_upsert_counter", "SELECT user_id, event_type, count(*) AS hits, max(event_id) AS last_event FROM events GROUP BY ALL")
def m01(spark, d):
    """Increments of every key, as one merge."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("hits"), F.max("event_id").alias("last_event"))


@query("m04_clamped_update", "SELECT c_custkey, greatest(0, least(100, coalesce(c_acctbal, 50) + 10)) AS trust FROM customer")
def m04(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("c_acctbal", F.lit(50.0)) + 10)).alias("trust"))


@query("x02_slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) AS slug FROM part")
def x02(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("x05_keyword_overlap", """SELECT p_partkey, len(list_intersect([w FOR w IN list_distinct(string_split_regex(lower(p_name), '[^a-z0-9]+')) IF length(w) >= 4], [w FOR w IN list_distinct(string_split_regex(lower(p_type), '[^a-z0-9]+')) IF length(w) >= 4])) AS shared FROM part""")
def x05(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(T.keywords(F.col("p_name")), T.keywords(F.col("p_type")))).cast("long").alias("shared"))
