"""More queries of the survey's operators, each with its oracle: filters, joins, merges, aggregates, windows, ranking, dedup and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import hamming, merges, ranking, sequences, stats
from tessera.sources.folders import cut
from tessera.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str):
    def put(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return put


@query("f05_optional_predicates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 50000")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """Only the predicates that are given take part."""
    asked = {"o_orderstatus = {}": "F", "o_orderpriority = {}": None, "o_totalprice >= {}": 50000}
    out = table(spark, d, "orders")
    for template, value in asked.items():
        if value is not None:
            out = out.where(template.format(repr(value)))
    return out.select("o_orderkey")


@query("f07_substring", "SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%' AND p_brand LIKE 'Brand#1%'")
def f07(spark, d):
    """F-07 and F-13: a substring in any case, and a prefix."""
    return table(spark, d, "part").where(F.col("p_type").ilike("%steel%") & F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("f14_bands", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'fit' WHEN p_size < 10 THEN 'small' ELSE 'large' END AS class FROM part WHERE p_retailprice BETWEEN 950 AND 1800")
def f14(spark, d):
    """F-14 and F-21: a band gate, then three disjoint classes."""
    size = F.col("p_size")
    label = F.when(size.between(10, 20), "fit").when(size < 10, "small").otherwise("large")
    return table(spark, d, "part").where(F.col("p_retailprice").between(950, 1800)).select("p_partkey", label.alias("class"))


@query("f22_first_non_empty", """WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS round FROM events WHERE event_type IN ('signup', 'purchase', 'view'))
  SELECT user_id, event_id, round FROM r JOIN (SELECT user_id, min(round) AS round FROM r GROUP BY user_id) USING (user_id, round)""")
def f22(spark, d):
    """Categories in order: each user keeps the first that has rows. The least round is aggregated before it is joined, so a hot user isn't sorted."""
    order = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    rows = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "view")).select("user_id", "event_id", order.alias("round"))
    return rows.join(rows.groupBy("user_id").agg(F.min("round").alias("round")), ["user_id", "round"]).select("user_id", "event_id", "round")


@query("j05_two_keys", """SELECT a.l_partkey, a.l_suppkey, a.returned, b.kept FROM (SELECT l_partkey, l_suppkey, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a
  JOIN (SELECT l_partkey, l_suppkey, count(*) AS kept FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def j05(spark, d):
    keys = ["l_partkey", "l_suppkey"]
    by = lambda flag, name: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return by("R", "returned").join(by("N", "kept"), keys)


@query("j06_dangling_key", "SELECT o.o_orderkey, c.c_custkey AS o_custkey FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def j06(spark, d):
    """A key without its row on the other side becomes null."""
    known = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_custkey").alias("o_custkey"))


_HASHES = "SELECT p_partkey AS id, xor((p_partkey // 4) * 2654435761 % 4294967296, p_partkey % 4) AS hash FROM part"


@query("j11_hamming", f"WITH h AS ({_HASHES}) SELECT a.hash AS left_hash, b.hash AS right_hash, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM h a JOIN h b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 3")
def j11(spark, d):
    """Different hashes within 3 bits of each other; equal ones are one row of the join."""
    key = F.col("p_partkey")
    high = (F.floor(key / 4) * F.lit(2654435761)) % F.lit(4294967296)
    return hamming.pairs(table(spark, d, "part").select(high.bitwiseXOR(key % 4).alias("hash")), "hash", 3, 32, cut)


@query("m02_monotone_upsert", "SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS bought, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_value, count(*) AS tries FROM events GROUP BY user_id")
def m02(spark, d):
    """A success is never taken back, and a present value replaces the one before (M-02, M-03)."""
    bought = F.col("event_type") == "purchase"
    last = F.max(F.when(bought, F.struct("ts", "event_id", "value")))["value"]
    return table(spark, d, "events").groupBy("user_id").agg(F.max(bought).alias("bought"), last.alias("last_value"), F.count(F.lit(1)).alias("tries"))


@query("m06_fair_pick", """SELECT o_orderkey FROM orders LEFT JOIN (SELECT o_custkey AS c, count(*) AS running FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c
  WHERE o_orderstatus = 'O' AND coalesce(running, 0) < 1 ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def m06(spark, d):
    """The oldest open order whose customer has none running; one row is the feature."""
    orders = table(spark, d, "orders")
    return merges.fair_pick(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'P'"), "o_custkey", ["o_orderdate", "o_orderkey"], 1).select("o_orderkey")


@query("m09_merge_patch", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def m09(spark, d):
    """A JSON object with a field added; the patch wins over what was there."""
    old = F.from_json("props", "map<string,string>")
    new = merges.patch(old, F.create_map(F.lit("kind"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", new["k"].cast("long").alias("k"), new["kind"].alias("kind"))


@query("m11_unique_slugs", "SELECT p_partkey, s || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part))")
def m11(spark, d):
    return merges.unique_slugs(table(spark, d, "part").select("p_partkey", T.slug(F.col("p_brand")).alias("slug")), "slug", "p_partkey")


@query("m12_canonical_rewrite", "SELECT p_partkey, lower(trim(p_type)) AS p_type FROM part WHERE p_type <> lower(trim(p_type))")
def m12(spark, d):
    return table(spark, d, "part").withColumn("old", F.col("p_type")).withColumn("p_type", F.lower(F.trim("old"))).where("old <> p_type").select("p_partkey", "p_type")


@query("a08_safe_ratio", "SELECT user_id, round(CASE WHEN v = 0 THEN 0 ELSE p / v END, 6) AS rate FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id)")
def a08(spark, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(stats.ratio(n("purchase"), n("view")), 6).alias("rate"))


@query("a13_bucket_bottleneck", """WITH g AS (SELECT CASE WHEN p_size < 15 THEN 'short' WHEN p_size < 35 THEN 'middle' ELSE 'long' END AS bucket, p_brand, avg(p_retailprice) AS a, count(*) AS n FROM part GROUP BY ALL)
  SELECT bucket, CAST(sum(n) AS BIGINT) AS n, arg_max(p_brand, (a, p_brand)) AS top FROM g GROUP BY bucket""")
def a13(spark, d):
    bucket = F.when(F.col("p_size") < 15, "short").when(F.col("p_size") < 35, "middle").otherwise("long").alias("bucket")
    by = table(spark, d, "part").groupBy(bucket, "p_brand").agg(F.avg("p_retailprice").alias("a"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("bucket").agg(F.sum("n").alias("n"), F.max_by("p_brand", F.struct("a", "p_brand")).alias("top"))


@query("a14_map_rollup", """SELECT key, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT 'price' AS key, p_retailprice AS v FROM part UNION ALL SELECT 'size', p_size - 10 FROM part) WHERE v > 0 GROUP BY key""")
def a14(spark, d):
    """Map entries by key; only positive values count."""
    pairs = table(spark, d, "part").select(F.explode(F.create_map(F.lit("price"), F.col("p_retailprice"), F.lit("size"), (F.col("p_size") - 10).cast("double"))).alias("key", "v"))
    return pairs.where("v > 0").groupBy("key").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("a23_last_wins", "SELECT kind, count(*) AS users FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events WHERE event_type <> 'error' GROUP BY user_id) GROUP BY kind")
def a23(spark, d):
    """The last value of each key without sentinels, counted."""
    last = table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("kind"))
    return last.groupBy("kind").agg(F.count(F.lit(1)).alias("users"))


@query("a24_clamped_sum", """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 4 WHEN 'error' THEN -3 ELSE 1 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT user_id, k, greatest(-10, least(10, x)) AS total FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, greatest(-10, least(10, r.total + e.x)) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
  SELECT user_id, CAST(arg_max(total, k) AS BIGINT) AS total FROM r GROUP BY user_id""")
def a24(spark, d):
    step = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "error", -3).otherwise(1).cast("long")
    rows = table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", step.alias("step"))
    return sequences.clamped_sum(rows, "user_id", "hour", ["ts", "event_id"], "step", -10, 10)


@query("a28_vector_mean", "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def a28(spark, d):
    """Mean of each place of the vectors of a label."""
    places = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return places.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("a29_two_threshold_verdict", "SELECT l_suppkey, CASE WHEN min(l_discount) < 0.01 AND avg(l_discount) < 0.05 THEN 'fail' WHEN avg(l_discount) < 0.05 THEN 'warn' ELSE 'pass' END AS verdict FROM lineitem GROUP BY l_suppkey")
def a29(spark, d):
    """By the worst and the mean; where a mean is 0.05 but for the last bits, they are added in the table's order."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_discount", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = stats.below(rows, "l_suppkey", "l_discount", 0.05, ["file", "row"], [F.min("l_discount").alias("worst")], cut)
    return found.select("l_suppkey", F.when(F.col("below") & (F.col("worst") < 0.01), "fail").when(F.col("below"), "warn").otherwise("pass").alias("verdict"))


@query("a45_first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def a45(spark, d):
    seen = F.struct("ts", "event_id", "event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.min(seen)["event_type"].alias("first"), F.max(seen)["event_type"].alias("last"), F.count_distinct("event_type").alias("kinds"))


_RUNS = """a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)"""


@query("w07_place_in_run", f"WITH {_RUNS} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS BIGINT) AS before, count(*) OVER (PARTITION BY user_id, run) >= 3 AS long_run FROM b")
def w07(spark, d):
    """W-07 and W-17: how many equal rows stand directly before, and whether the row lies in a run of three or more."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    return sequences.in_runs(rows, "user_id", "hour", ["ts", "event_id"], "event_type").select("event_id", "before", (F.col("run_length") >= 3).alias("long_run"))


@query("w13_relative_threshold", "SELECT o_custkey, o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_totalprice) * 0.22 AS least FROM orders GROUP BY o_custkey) USING (o_custkey) WHERE o_totalprice >= least")
def w13(spark, d):
    """Rows within a share of their group's best, which is aggregated before it is joined."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    least = orders.groupBy("o_custkey").agg((F.max("o_totalprice") * 0.22).alias("least"))
    return orders.join(least, "o_custkey").where("o_totalprice >= least").select("o_custkey", "o_orderkey")


@query("w15_rescaled", """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_quantity * CASE l_returnflag WHEN 'R' THEN 82 WHEN 'N' THEN 100 ELSE 122 END AS x FROM lineitem)
  SELECT l_orderkey, l_linenumber, x * sum(q) OVER (PARTITION BY l_orderkey) / sum(x) OVER (PARTITION BY l_orderkey) AS scaled FROM m""")
def w15(spark, d):
    """Weighted parts that keep the sum of their group; weights in hundredths, so that sums of whole quantities are exact in any order."""
    weight = F.when(F.col("l_returnflag") == "R", 82).when(F.col("l_returnflag") == "N", 100).otherwise(122)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_quantity") * weight).alias("x"))
    group = Window.partitionBy("l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", (F.col("x") * F.sum("q").over(group) / F.sum("x").over(group)).alias("scaled"))


@query("r02_gaussian_fit", "SELECT p_partkey, round(exp(-((p_size - 25.0) * (p_size - 25.0)) / 1800), 6) AS fit FROM part")
def r02(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(ranking.gaussian(F.col("p_size"), 25.0, 30.0), 6).alias("fit"))


@query("r11_margin_rule", """WITH b AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS stock, max(o_totalprice) FILTER (o_orderstatus <> 'F') AS other FROM orders GROUP BY o_custkey)
  SELECT o_custkey, CASE WHEN stock IS NULL THEN 'other' WHEN other IS NULL OR stock >= other + 1000 THEN 'stock' ELSE 'other' END AS winner FROM b""")
def r11(spark, d):
    """One class wins only by a margin over the best of the others."""
    best = lambda cond: F.max(F.when(cond, F.col("o_totalprice")))
    status = F.col("o_orderstatus")
    by = table(spark, d, "orders").groupBy("o_custkey").agg(best(status == "F").alias("stock"), best(status != "F").alias("other"))
    wins = F.col("stock").isNotNull() & (F.col("other").isNull() | (F.col("stock") >= F.col("other") + 1000))
    return by.select("o_custkey", F.when(wins, "stock").otherwise("other").alias("winner"))


@query("r35_interpolated", "SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 8 WHEN p_size <= 20 THEN 8 + (p_size - 5) * 12 / 15.0 WHEN p_size <= 40 THEN 20 + (p_size - 20) * 5 / 20.0 ELSE 25 END, 6) AS budget FROM part")
def r35(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(ranking.interpolate(F.col("p_size"), [(5, 8), (20, 20), (40, 25)]), 6).alias("budget"))


@query("r39_fatigue", "SELECT p_partkey, round(p_retailprice * CASE WHEN n <= 0 THEN 1 WHEN n = 1 THEN 0.75 WHEN n = 2 THEN 0.4 ELSE 0.1 END, 4) AS score FROM (SELECT p_partkey, p_retailprice, p_size % 6 AS n FROM part)")
def r39(spark, d):
    """Each earlier use lowers the score; from the third on by the last factor."""
    uses = F.least(F.col("p_size") % 6, F.lit(3))
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * F.array(*map(F.lit, (1.0, 0.75, 0.4, 0.1)))[uses], 4).alias("score"))


@query("d01_keyed_merge", "SELECT l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first_order, max(l_discount) AS discount, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_partkey")
def d01(spark, d):
    """One row a key: the first survives, scores take the best, labels their union (a closed set)."""
    by = table(spark, d, "lineitem").groupBy("l_partkey")
    return by.agg(F.min(F.struct("l_orderkey", "l_linenumber"))["l_orderkey"].alias("first_order"), F.max("l_discount").alias("discount"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))


@query("d10_adjacent_ranges", "SELECT * FROM (SELECT user_id, event_id, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) AS seconds FROM events) WHERE seconds >= 3600")
def d10(spark, d):
    """Ranges from a point to the next, without short ones."""
    at = lambda c: c.cast("timestamp").cast("double")
    ahead = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", (at(ahead) - at(F.col("ts"))).alias("seconds")).where("seconds >= 3600")


@query("x15_canonical_url", "SELECT page_id, lower(split_part(url, '?', 1)) AS url FROM pages")
def x15(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("x16_duration_label", "SELECT o_orderkey, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS label FROM (SELECT o_orderkey, o_orderkey % 4000 AS s FROM orders)")
def x16(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.duration(F.col("o_orderkey") % 4000).alias("label"))


@query("x20_composite_key", "SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(source, '')) AS key FROM documents")
def x20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).cast("binary"), 256).alias("key"))


@query("x27_half_up", "SELECT c_custkey, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS rounded FROM customer")
def x27(spark, d):
    """Halves go up, for negative values too."""
    return table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") + 0.5).alias("rounded"))


@query("t04_heartbeat", "SELECT event_type, max(ts) AS last, epoch(max(max(ts)) OVER ()) - epoch(max(ts)) > 300 AS stale FROM events GROUP BY event_type")
def t04(spark, d):
    """The latest row of each role, stale 300 seconds after the latest of all."""
    last = table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    seconds = lambda c: c.cast("timestamp").cast("double")
    newest = last.agg(F.max("last").alias("newest"))  # one row
    return last.crossJoin(F.broadcast(newest)).select("event_type", "last", (seconds(F.col("newest")) - seconds(F.col("last")) > 300).alias("stale"))


@query("t06_change_feed", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS DISTINCT FROM event_type")
def t06(spark, d):
    """Rows whose payload differs from the one before."""
    old = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("old", old).where(~F.col("old").eqNullSafe(F.col("event_type"))).select("event_id")


@query("t16_negative_cache", "SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'error' AND f.user_id = e.user_id AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 6 HOUR)")
def t16(spark, d):
    """Keys that failed in the last six hours are passed over: the last failure before each row, without a join."""
    events = table(spark, d, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    recent = Window.partitionBy("user_id").orderBy("ts").rangeBetween(-6 * 3600 * 1_000_000, -1)
    failed = F.count(F.when(F.col("event_type") == "error", 1)).over(recent)
    return events.withColumn("failed", failed).where("event_type = 'view' AND failed = 0").select("event_id")
