"""Aggregations and window computations of the survey over the driver's tables, each with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.operators import intervals, ranking, sequences, stats, vectors
from tessera.plans.book import book
from tessera.sources.folders import cut
from tessera.sources.tables import table

QUERIES, ORACLES, query = book()


def n_rows() -> Column:
    return F.count(F.lit(1))


@query("a01_filtered_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def a01(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").agg(n_rows().alias("n"))


@query("a02_counts_of_some", "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def a02(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).groupBy("user_id").agg(n_rows().alias("n"))


@query("a05_open_histogram", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def a05(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(n_rows().alias("n"))


@query("a07_averages", "SELECT d.source, round(avg(l.quality), 6) AS quality, round(avg(l.toxic), 6) AS toxic, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def a07(spark, d):
    """Nulls don't count; a group of nulls alone has a null."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").withColumn("seen", F.lit(1)), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count("seen").alias("n"))


@query("a09_share", "WITH s AS (SELECT event_type, round(sum(value), 2) AS total FROM events GROUP BY event_type) SELECT event_type, total, round(total / sum(total) OVER (), 6) AS share FROM s")
def a09(spark, d):
    """Of few classes, their share of the sum."""
    by = table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"))
    return by.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))), 6))


@query("a15_stage_summary", """SELECT event_type, user_id % 4 AS variant, count(*) AS n, round(avg(CASE WHEN value >= 5 THEN 1.0 ELSE 0 END), 6) AS success, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0 END), 6) AS failure, round(avg(value), 6) AS mean,
  round(avg(value) FILTER (value >= 5), 6) AS mean_success, round(sum(CAST(json_extract(props, '$.k') AS BIGINT) % 3) / count(*), 6) AS retry_rate, max(value) AS worst FROM events GROUP BY ALL""")
def a15(spark, d):
    """Eight metrics by stage and variant in one pass."""
    ok, k = F.col("value") >= 5, F.from_json("props", "k long")["k"]
    by = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 4).alias("variant"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return by.agg(n_rows().alias("n"), share(ok).alias("success"), share(~ok).alias("failure"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean_success"), F.round(F.sum(k % 3) / n_rows(), 6).alias("retry_rate"), F.max("value").alias("worst"))


@query("a16_running_rates", """SELECT l_suppkey, l_orderkey, l_linenumber, round(sum(l_quantity) OVER w, 2) AS total, count(*) OVER w AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 6) AS rate
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def a16(spark, d):
    """Sums, counts and rates so far, per supplier and part."""
    w = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w)
    rate = F.round(F.sum((F.col("l_returnflag") == "R").cast("int")).over(w) / n, 6)
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("total"), n.alias("n"), rate.alias("rate"))


@query("a17_top_five_sources", "WITH r AS (SELECT l_suppkey % 7 AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem) SELECT source, count(*) AS n FROM r WHERE k <= 5 GROUP BY source")
def a17(spark, d):
    """How often a source is among the first five of a run."""
    first = ranking.top(table(spark, d, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], 5)
    return first.groupBy((F.col("l_suppkey") % 7).alias("source")).agg(n_rows().alias("n"))


@query("a21_distinct_first_seen", "WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS k FROM f) SELECT user_id, list(event_type ORDER BY f) AS types FROM r WHERE k <= 3 GROUP BY user_id")
def a21(spark, d):
    """Distinct values in the order first seen, three at most. Only first sights are gathered."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    kept = ranking.top(first, "user_id", [F.col("f")], 3)
    return kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]).alias("types"))


@query("a25_trends", """WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
  u AS (SELECT user_id, unnest(['size', 'rest']) AS dimension, unnest([coalesce(value * 8, 50), CAST(event_id_mod AS DOUBLE)]) AS score FROM (SELECT *, 40 + length(event_type) * 4 AS event_id_mod FROM r) WHERE k <= 20)
  SELECT user_id, dimension, round(avg(score), 4) AS mean, round(min(score), 4) AS least, count(*) AS n, round(avg(score), 4) < 65 AND count(*) >= 3 AS weak, floor(avg(score) + 0.5) < 60 AND count(*) >= 5 AS persistent FROM u GROUP BY user_id, dimension""")
def a25(spark, d):
    """Per dimension over the latest 20 rows of a user: mean, minimum, count, and whether it is weak; what is missing counts 50."""
    last = ranking.top(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20)
    scores = {"size": F.coalesce(F.col("value") * 8, F.lit(50.0)), "rest": (40 + F.length("event_type") * 4).cast("double")}
    long = last.select("user_id", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("score")) for k, v in scores.items()))).alias("x")).select("user_id", "x.dimension", "x.score")
    by = long.groupBy("user_id", "dimension").agg(F.avg("score").alias("a"), F.round(F.min("score"), 4).alias("least"), n_rows().alias("n"))
    return by.select("user_id", "dimension", F.round("a", 4).alias("mean"), "least", "n", ((F.round("a", 4) < 65) & (F.col("n") >= 3)).alias("weak"), ((F.floor(F.col("a") + 0.5) < 60) & (F.col("n") >= 5)).alias("persistent"))


@query("a26_weighted_dimensions", "SELECT user_id, round(sum(value * CASE event_type WHEN 'click' THEN 0.1 WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 0.15 ELSE 0.25 END), 4) AS score FROM events GROUP BY user_id")
def a26(spark, d):
    weights = F.create_map(*(F.lit(x) for kv in {"click": 0.1, "purchase": 0.5, "view": 0.15}.items() for x in kv))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.coalesce(F.try_element_at(weights, "event_type"), F.lit(0.25))), 4).alias("score"))


@query("a30_merit", """WITH s AS (SELECT l_orderkey, avg(l_quantity) AS a, min(l_quantity) AS m, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, round(greatest(CASE WHEN m >= 20 THEN 40 ELSE 0 END, least(100, greatest(0, 0.7 * a * 2 + 0.3 * m * 2 + CASE WHEN sources >= 4 THEN 8 ELSE 0 END + CASE WHEN n >= 5 THEN 4 ELSE 0 END - least(25, 6 * bad)))), 4) AS merit FROM s""")
def a30(spark, d):
    """Mean and minimum, bonuses, penalties up to a cap, and a floor under a condition."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("a"), F.min("l_quantity").alias("m"), n_rows().alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.count_distinct("l_suppkey").alias("sources"))
    base = 0.7 * F.col("a") * 2 + 0.3 * F.col("m") * 2 + F.when(F.col("sources") >= 4, 8).otherwise(0) + F.when(F.col("n") >= 5, 4).otherwise(0) - F.least(F.lit(25), 6 * F.col("bad"))
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), base))
    return s.select("l_orderkey", F.round(F.greatest(F.when(F.col("m") >= 20, 40.0).otherwise(0.0), clamped), 4).alias("merit"))


@query("a31_bottleneck", """WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS total FROM events GROUP BY ALL)
  SELECT user_id, round(sum(total), 4) AS grand, arg_max(event_type, (total, event_type)) AS bottleneck, max(total) AS most FROM s GROUP BY user_id""")
def a31(spark, d):
    """Totals by category, their sum, and the largest."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"))
    return s.groupBy("user_id").agg(F.round(F.sum("total"), 4).alias("grand"), F.max_by("event_type", F.struct("total", "event_type")).alias("bottleneck"), F.max("total").alias("most"))


@query("a33_coverage", """WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, o_orderstatus FROM orders)
  SELECT c_custkey, round(least(1, coalesce(max(o_totalprice) FILTER (k <= 5 AND o_orderstatus = 'F') / 300000, max(o_totalprice) FILTER (k <= 5) / 600000, 0)), 6) AS coverage FROM customer LEFT JOIN r ON c_custkey = o_custkey GROUP BY c_custkey""")
def a33(spark, d):
    """The best similarity of the first five, else the best keyword score, at most 1."""
    first = ranking.top(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    best = first.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("s"), F.max("o_totalprice").alias("k"))
    cover = F.coalesce(F.col("s") / 300000, F.col("k") / 600000, F.lit(0.0))
    return table(spark, d, "customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", F.round(F.least(F.lit(1.0), cover), 6).alias("coverage"))


@query("a34_idle", "SELECT user_id, round(greatest(0, epoch(max(ts) - min(ts)) - sum(value) * 60), 3) AS idle FROM events GROUP BY user_id")
def a34(spark, d):
    """Wall time without the stages' times, not below 0."""
    wall = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), wall - F.sum("value") * 60), 3).alias("idle"))


@query("a35_hit_rates", """SELECT date_trunc('day', ts) AS day, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS cache, round(count(*) FILTER (event_type IN ('click', 'view')) / count(*), 6) AS keyword, round(CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 0 ELSE count(*) FILTER (event_type = 'refund') / count(*) FILTER (event_type = 'error') END, 6) AS fallback FROM events GROUP BY 1""")
def a35(spark, d):
    """Hit rates by phase; 0 where a phase wasn't reached."""
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    by = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"))
    return by.agg(F.round(n("click") / n_rows(), 6).alias("cache"), F.round(n("click", "view") / n_rows(), 6).alias("keyword"), F.round(stats.ratio(n("refund"), n("error")), 6).alias("fallback"))


@query("a36_uniqueness", """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, list_dot_product(q.e, b.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, greatest(0, least(100, 100 - 15 * count(*) FILTER (s >= 0.55))) AS uniqueness FROM p GROUP BY query_id""")
def a36(spark, d):
    """100 less 15 for each near vector, for every hundredth vector (the stated query set)."""
    v = table(spark, d, "embeddings")
    near = vectors.probed(v, v.where("vec_id % 100 = 0"), [0.55])
    return near.select(F.col("id").alias("query_id"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * F.col("near_0"))).alias("uniqueness"))


@query("a37_completeness", """WITH c AS (SELECT p_partkey, (CAST(length(p_name) >= 9 AS INTEGER) + CAST(contains(p_name, 'r') AS INTEGER) + CAST(p_size >= 10 AS INTEGER) + CAST(p_retailprice >= 1000 AS INTEGER) + CAST(p_brand LIKE '%1%' AS INTEGER) + CAST(p_type <> 'ECONOMY' AS INTEGER)) / 6 AS filled, p_size / 50 AS size, least(p_retailprice / 2000, 1) AS price FROM part)
  SELECT p_partkey, round(filled, 6) AS completeness, round(100 * (0.35 * filled + 0.25 * size + 0.25 * price + 0.15 * coalesce(nullif(size, 0.2), filled)), 7) AS health FROM c""")
def a37(spark, d):
    """The share of filled checks, and a blend with a fallback for what is missing."""
    checks = [F.length("p_name") >= 9, F.contains("p_name", F.lit("r")), F.col("p_size") >= 10, F.col("p_retailprice") >= 1000, F.col("p_brand").contains("1"), F.col("p_type") != "ECONOMY"]
    filled = reduce(lambda a, b: a + b, [c.cast("int") for c in checks]) / len(checks)
    size, price = F.col("p_size") / 50, F.least(F.col("p_retailprice") / 2000, F.lit(1.0))
    blend = 0.35 * filled + 0.25 * size + 0.25 * price + 0.15 * F.coalesce(F.nullif(size, F.lit(0.2)), filled)
    return table(spark, d, "part").select("p_partkey", F.round(filled, 6).alias("completeness"), F.round(100 * blend, 7).alias("health"))


@query("a38_vision_calls", """WITH c AS (SELECT l_orderkey, count(*) AS candidates, sum(l_extendedprice) AS price, avg(l_quantity) AS q, avg(l_discount) AS di, avg(l_tax) AS t FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderpriority, count(*) AS calls, CAST(sum(candidates) AS BIGINT) AS candidates, round(sum(price) / count(*), 2) AS per_call, round(sum(price) / sum(candidates), 2) AS per_candidate, round(avg(q), 4) AS quantity, round(avg(di), 6) AS discount, round(avg(t), 6) AS tax, round(sum(candidates) * 0.0015, 4) AS cost FROM c JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def a38(spark, d):
    """Means by call and by candidate, means of dimensions, and cost."""
    calls = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n_rows().alias("candidates"), F.sum("l_extendedprice").alias("price"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("di"), F.avg("l_tax").alias("t"))
    by = calls.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("o_orderpriority")
    n, price = F.sum("candidates"), F.sum("price")
    return by.agg(n_rows().alias("calls"), n.alias("candidates"), F.round(price / n_rows(), 2).alias("per_call"), F.round(price / n, 2).alias("per_candidate"), F.round(F.avg("q"), 4).alias("quantity"), F.round(F.avg("di"), 6).alias("discount"), F.round(F.avg("t"), 6).alias("tax"), F.round(n * 0.0015, 4).alias("cost"))


RUNS = """r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events)),
  g AS (SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run)"""


@query("a39_variety_review", f"""WITH {RUNS}, p AS (SELECT user_id, CAST(sum(greatest(n - 2, 0)) AS BIGINT) AS over_runs, CAST(sum(n) AS BIGINT) AS shots, count(DISTINCT event_type) AS kinds, CAST(coalesce(sum(n) FILTER (event_type = 'view'), 0) AS BIGINT) AS views FROM g GROUP BY user_id)
  SELECT user_id, greatest(0, 100 - 10 * over_runs - 8 * (6 - kinds) - CASE WHEN views * 2 > shots THEN 15 ELSE 0 END) AS score FROM p""")
def a39(spark, d):
    """Penalties for long runs, for missing classes, and for a class with more than half."""
    g = stats.runs(table(spark, d, "events"), "user_id", ["event_id"], "event_type")
    p = g.groupBy("user_id").agg(F.sum(F.greatest(F.col("length") - 2, F.lit(0))).alias("over_runs"), F.sum("length").alias("shots"), F.count_distinct("event_type").alias("kinds"), F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("length"))), F.lit(0)).alias("views"))
    penalty = 10 * F.col("over_runs") + 8 * (6 - F.col("kinds")) + F.when(F.col("views") * 2 > F.col("shots"), 15).otherwise(0)
    return p.select("user_id", F.greatest(F.lit(0), 100 - penalty).alias("score"))


@query("a40_transition_review", f"""WITH {RUNS}, p AS (SELECT user_id, count(*) FILTER (event_type <> 'view' AND n >= 3) AS long_runs, CAST(sum(n) AS BIGINT) AS n, coalesce(sum(n) FILTER (event_type = 'view'), 0) / sum(n) AS cut FROM g GROUP BY user_id)
  SELECT user_id, long_runs, round(cut, 6) AS cut_share, CASE WHEN n >= 6 AND cut > 0.85 THEN 'flat' WHEN cut < 0.3 THEN 'restless' ELSE 'fine' END AS verdict FROM p""")
def a40(spark, d):
    """Runs of three or more that aren't cuts, and whether cuts are too many or too few."""
    g = stats.runs(table(spark, d, "events"), "user_id", ["event_id"], "event_type")
    cut = F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("length"))), F.lit(0)) / F.sum("length")
    p = g.groupBy("user_id").agg(F.count_if((F.col("event_type") != "view") & (F.col("length") >= 3)).alias("long_runs"), F.sum("length").alias("n"), cut.alias("cut"))
    verdict = F.when((F.col("n") >= 6) & (F.col("cut") > 0.85), "flat").when(F.col("cut") < 0.3, "restless").otherwise("fine")
    return p.select("user_id", "long_runs", F.round("cut", 6).alias("cut_share"), verdict.alias("verdict"))


@query("a41_caption_density", """WITH c AS (SELECT conv_id, turn, len(list_filter(string_split(coalesce(text, ''), '.'), lambda s: length(trim(s)) >= 20)) AS captions, length(coalesce(text, '')) AS duration FROM conversations)
  SELECT conv_id, round(CASE WHEN sum(duration) = 0 THEN 0 ELSE sum(least(captions * 40, duration)) / sum(duration) END, 6) AS density, count(*) FILTER (captions > 3) AS crowded, CASE WHEN sum(duration) > 0 AND sum(least(captions * 40, duration)) / sum(duration) > 0.6 THEN 20 ELSE 0 END + 5 * count(*) FILTER (captions > 3) AS penalty FROM c GROUP BY conv_id""")
def a41(spark, d):
    """What is shown of the whole duration, and beats with more than three captions."""
    captions = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\."), lambda s: F.length(F.trim(s)) >= 20))
    rows = table(spark, d, "conversations").select("conv_id", captions.alias("captions"), F.length(F.coalesce("text", F.lit(""))).alias("duration"))
    by = rows.groupBy("conv_id").agg(F.sum(F.least(F.col("captions") * 40, "duration")).alias("shown"), F.sum("duration").alias("duration"), F.count_if(F.col("captions") > 3).alias("crowded"))
    density = stats.ratio(F.col("shown"), F.col("duration"))
    return by.select("conv_id", F.round(density, 6).alias("density"), "crowded", (F.when(density > 0.6, 20).otherwise(0) + 5 * F.col("crowded")).alias("penalty"))


@query("a43_fallback_share", "SELECT source, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END), 6) AS fallback, count(*) AS n, CASE WHEN avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) > 0.5 THEN 60 WHEN avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) > 0.25 THEN 20 ELSE 0 END AS penalty FROM documents GROUP BY source")
def a43(spark, d):
    share = F.avg((F.col("lang") == "en").cast("double"))
    by = table(spark, d, "documents").groupBy("source").agg(share.alias("s"), n_rows().alias("n"))
    return by.select("source", F.round("s", 6).alias("fallback"), "n", F.when(F.col("s") > 0.5, 60).when(F.col("s") > 0.25, 20).otherwise(0).alias("penalty"))


@query("a44_class_against_strategy", """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS modern, count(*) FILTER (l_returnflag = 'A') AS archive FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey, modern, archive, modern > 0 AND modern >= archive AS conflict FROM c JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def a44(spark, d):
    """In scenes with an archive strategy, modern rows that are as many as the archive's."""
    n = lambda v: F.count_if(F.col("l_returnflag") == v)
    scenes = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").groupBy("o_orderkey").agg(n("N").alias("modern"), n("A").alias("archive"))
    return rows.join(scenes, "o_orderkey").withColumn("conflict", (F.col("modern") > 0) & (F.col("modern") >= F.col("archive")))


@query("a46_retention_risk", """WITH s AS (SELECT user_id, count(*) FILTER (value > 12) AS risks, arg_min(event_type, event_id) AS opening FROM events GROUP BY user_id)
  SELECT user_id, risks, greatest(0, 100 - least(50, 10 * risks) - CASE WHEN opening IN ('error', 'refund') THEN 20 ELSE 0 END) AS score FROM s""")
def a46(spark, d):
    """A penalty by risks, capped at 50, and one for a weak opening."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 12).alias("risks"), F.min_by("event_type", "event_id").alias("opening"))
    weak = F.when(F.col("opening").isin("error", "refund"), 20).otherwise(0)
    return s.select("user_id", "risks", F.greatest(F.lit(0), 100 - F.least(F.lit(50), 10 * F.col("risks")) - weak).alias("score"))


@query("a47_report", """WITH p AS (SELECT user_id, 'value' AS review, CASE WHEN value > 16 THEN 'high' ELSE 'low' END AS severity FROM events WHERE value > 11 UNION ALL SELECT user_id, 'kind', 'medium' FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, 'refund', 'high' FROM events WHERE event_type = 'refund' AND value > 8),
  c AS (SELECT user_id, count(*) AS problems, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM p GROUP BY user_id), t AS (SELECT user_id, greatest(0, 100 - 6 * problems) AS score, high, medium FROM c)
  SELECT user_id, score, high, medium, CASE WHEN high >= 3 OR score < 45 THEN 'rejected' WHEN high >= 1 OR score < 65 THEN 'revise' WHEN score < 80 THEN 'minor' ELSE 'approved' END AS status FROM t""")
def a47(spark, d):
    """The problems of several reviews together, their severities, and the status that follows."""
    events = table(spark, d, "events")
    parts = [("value", "value > 11", F.when(F.col("value") > 16, "high").otherwise("low")), ("kind", "event_type = 'error'", F.lit("medium")), ("refund", "event_type = 'refund' AND value > 8", F.lit("high"))]
    problems = reduce(lambda a, b: a.unionByName(b), [events.where(w).select("user_id", F.lit(r).alias("review"), s.alias("severity")) for r, w, s in parts])
    n = lambda v: F.count_if(F.col("severity") == v)
    c = problems.groupBy("user_id").agg(n_rows().alias("problems"), n("high").alias("high"), n("medium").alias("medium")).withColumn("score", F.greatest(F.lit(0), 100 - 6 * F.col("problems")))
    status = F.when((F.col("high") >= 3) | (F.col("score") < 45), "rejected").when((F.col("high") >= 1) | (F.col("score") < 65), "revise").when(F.col("score") < 80, "minor").otherwise("approved")
    return c.select("user_id", "score", "high", "medium", status.alias("status"))


@query("a48_profile", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
  SELECT user_id, CAST(sum(n) AS BIGINT) AS total, round(coalesce(sum(n) FILTER (event_type = 'view'), 0) / sum(n), 6) AS views, arg_max(event_type, (n, -f)) AS dominant, round(count(*) / sum(n), 6) AS variety FROM c GROUP BY user_id""")
def a48(spark, d):
    """Shares, the dominant class (the first seen among equals), and classes by rows."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(n_rows().alias("n"), F.min("event_id").alias("f"))
    views = F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("n"))), F.lit(0))
    return c.groupBy("user_id").agg(F.sum("n").alias("total"), F.round(views / F.sum("n"), 6).alias("views"), F.max_by("event_type", F.struct("n", -F.col("f"))).alias("dominant"), F.round(n_rows() / F.sum("n"), 6).alias("variety"))


@query("a49_severity_rollup", "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_quantity >= 45) >= 2 THEN 'poor' WHEN count(*) FILTER (l_quantity >= 45) = 1 OR count(*) FILTER (l_quantity BETWEEN 35 AND 44) >= 2 THEN 'fair' ELSE 'good' END AS quality FROM lineitem GROUP BY l_orderkey")
def a49(spark, d):
    high, medium = F.count_if(F.col("l_quantity") >= 45), F.count_if(F.col("l_quantity").between(35, 44))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(high >= 2, "poor").when((high == 1) | (medium >= 2), "fair").otherwise("good").alias("quality"))


@query("a50_over_budget", """WITH s AS (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY user_id, event_type), t(event_type, target) AS (VALUES ('click', 0.3), ('view', 0.4), ('purchase', 0.1))
  SELECT user_id, s.event_type, round(n / total, 6) AS share FROM s JOIN t ON s.event_type = t.event_type WHERE total >= 5 AND n / total > 1.5 * target""")
def a50(spark, d):
    """Classes with more than 1.5 times their target share, of users with five rows or more."""
    targets = F.create_map(*(F.lit(x) for kv in {"click": 0.3, "view": 0.4, "purchase": 0.1}.items() for x in kv))
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(n_rows().alias("n"))
    s = s.withColumn("total", F.sum("n").over(Window.partitionBy("user_id"))).withColumn("target", F.try_element_at(targets, "event_type"))
    return s.where((F.col("total") >= 5) & (F.col("n") / F.col("total") > 1.5 * F.col("target"))).select("user_id", "event_type", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("a51_shortfall", "SELECT o_custkey, count(*) AS wanted, count(*) FILTER (o_orderstatus = 'F') AS found, greatest(0, ceil(count(*) * 0.5) - count(*) FILTER (o_orderstatus = 'F')) AS missing FROM orders GROUP BY o_custkey")
def a51(spark, d):
    by = table(spark, d, "orders").groupBy("o_custkey").agg(n_rows().alias("wanted"), F.count_if(F.col("o_orderstatus") == "F").alias("found"))
    return by.withColumn("missing", F.greatest(F.lit(0), F.ceil(F.col("wanted") * 0.5) - F.col("found")).cast("double"))


@query("w02_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def w02(spark, d):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).cast("long").alias("place"))


@query("w06_static_runs", """WITH m AS (SELECT user_id, event_id, event_type, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) < 4 AS still, event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS same FROM events),
  g AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m), c AS (SELECT user_id, run, count(*) AS n FROM g GROUP BY user_id, run)
  SELECT c.user_id, count(*) FILTER (n >= 3) AS static_runs, max(n) AS longest, any_value(r.repeats) AS repeats FROM c JOIN (SELECT user_id, count(*) FILTER (same) AS repeats FROM m GROUP BY user_id) r ON c.user_id = r.user_id GROUP BY c.user_id""")
def w06(spark, d):
    """Runs of rows that hardly move, and how often a movement is repeated."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    m = table(spark, d, "events").select("user_id", "event_id", (F.abs(F.col("value") - F.lag("value").over(by)) < 4).alias("still"), F.col("event_type").eqNullSafe(F.lag("event_type").over(by)).alias("same"))
    g = m.withColumn("run", F.sum(F.when(F.col("still"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    c = g.groupBy("user_id", "run").agg(n_rows().alias("n"), F.count_if("same").alias("same"))
    return c.groupBy("user_id").agg(F.count_if(F.col("n") >= 3).alias("static_runs"), F.max("n").alias("longest"), F.sum("same").alias("repeats"))


@query("w09_split_windows", """WITH r AS (SELECT user_id, event_id, ts, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events)),
  w AS (SELECT user_id, run, min(epoch_us(ts)) AS a, count(*) AS n FROM r GROUP BY user_id, run), x AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY run) AS b FROM w)
  SELECT r.user_id, r.event_id, round((x.a + (coalesce(x.b, x.a) - x.a) / x.n * (row_number() OVER (PARTITION BY r.user_id, r.run ORDER BY r.event_id) - 1)) / 1000000, 3) AS at FROM r JOIN x ON r.user_id = x.user_id AND r.run = x.run""")
def w09(spark, d):
    """The window of a run, up to the next one, in equal parts for its members."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    by = Window.partitionBy("user_id").orderBy("event_id")
    new = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(by))) | (F.row_number().over(by) == 1)
    r = events.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    w = r.groupBy("user_id", "run").agg(F.min("us").alias("a"), n_rows().alias("n")).withColumn("b", F.coalesce(F.lead("a").over(Window.partitionBy("user_id").orderBy("run")), "a"))
    k = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id")) - 1
    return r.join(w, ["user_id", "run"]).select("user_id", "event_id", F.round((F.col("a") + (F.col("b") - F.col("a")) / F.col("n") * k) / 1000000, 3).alias("at"))


@query("w10_offsets_with_crossfade", "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity - 0.5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - (l_quantity - 0.5), 4) AS start FROM lineitem")
def w10(spark, d):
    """Where each clip begins when neighbours share half a unit."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("l_quantity") - 0.5
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sum(step).over(by) - step, 4).alias("start"))


@query("w11_best_window", """WITH e AS (SELECT user_id, epoch_us(ts) / 3600000000 AS h, value FROM events), b AS (SELECT user_id, floor(min(h)) AS lo, floor(max(h)) AS hi FROM e GROUP BY user_id),
  c AS (SELECT user_id, d AS duration, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1, 1)) AS start FROM b, (VALUES (3), (5), (8)) v(d)), s AS (SELECT c.user_id, duration, start, round(coalesce(sum(value), 0) / duration, 6) AS score FROM c LEFT JOIN e ON c.user_id = e.user_id AND e.h >= c.start AND e.h < c.start + duration GROUP BY c.user_id, duration, start)
  SELECT user_id, duration, arg_max(start, (score, -start)) AS start, max(score) AS score FROM s GROUP BY user_id, duration""")
def w11(spark, d):
    """The best window of 3, 5 and 8 hours at each hour of a user's time; the first of the best. A row goes to the windows that hold it, hour
    by hour sums first, so that what is joined are sums."""
    hours = table(spark, d, "events").groupBy("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("hour")).agg(F.sum("value").alias("v"))
    bounds = hours.groupBy("user_id").agg(F.min("hour").alias("lo"))
    windows = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (3, 5, 8))), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(n.alias("duration"), (F.col("hour") - k).alias("start"))))))
    sums = hours.join(bounds, "user_id").select("user_id", "lo", "v", "hour", windows.alias("w")).where("w.start >= lo").groupBy("user_id", "w.duration", "w.start").agg(F.round(F.sum("v") / F.first("w.duration"), 6).alias("score"))
    return sums.groupBy("user_id", "duration").agg(F.max_by("start", F.struct("score", -F.col("start"))).alias("start"), F.max("score").alias("score"))


_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag"


@query("w11_best_windows", f"""WITH s AS (SELECT l_orderkey, sum(q) OVER w - q AS a, sum(q) OVER w AS b, l_returnflag = 'R' AS close, l_discount > 0.07 AS persons, l_tax > 0.06 AS emotion, l_partkey % 7 = 0 AS micro, l_suppkey % 3 = 0 AS hit
    FROM (SELECT *, l_quantity / 4 AS q FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT l_orderkey, n, unnest(range(0, CAST(floor(2 * (max(b) - n)) AS BIGINT) + 1)) AS k FROM s, (VALUES (3), (5), (8), (10)) v(n) GROUP BY l_orderkey, n HAVING max(b) >= n),
  x AS (SELECT c.l_orderkey, n, k, CASE WHEN count(a) = 0 THEN 30 ELSE least(100, 50 + 10 * CAST(bool_or(close) AS INTEGER) + 8 * CAST(bool_or(persons) AS INTEGER) + 7 * CAST(bool_or(emotion) AS INTEGER) + 8 * CAST(bool_or(micro) AS INTEGER) + least(10, 4 * count(*) FILTER (hit))) END AS score
    FROM c LEFT JOIN s ON c.l_orderkey = s.l_orderkey AND b > k / 2 AND a < k / 2 + n GROUP BY c.l_orderkey, n, k)
  SELECT l_orderkey, n AS duration, arg_max(k, (score, -k)) / 2 AS start, max(score) AS score FROM x GROUP BY l_orderkey, n""")
def w11_half_steps(spark, d):
    """Windows of 3, 5, 8 and 10 seconds at half seconds over an order's lines, one after the other for a quarter second each unit: the
    first of the best."""
    by = Window.partitionBy("l_orderkey").orderBy(*_LINES.split(", ")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("l_quantity") / 4
    flags = {"close": F.col("l_returnflag") == "R", "persons": F.col("l_discount") > 0.07, "emotion": F.col("l_tax") > 0.06, "micro": F.col("l_partkey") % 7 == 0, "hit": F.col("l_suppkey") % 3 == 0}
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.sum(q).over(by) - q).alias("start"), F.sum(q).over(by).alias("end"), *(c.alias(n) for n, c in flags.items()))
    return intervals.best_windows(None, lines, "l_orderkey", [3, 5, 8, 10], cut)


@query("w12_latency_sample", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM r WHERE k <= 1000 GROUP BY event_type")
def w12(spark, d):
    """The last thousand rows of each class."""
    return ranking.top(table(spark, d, "events"), "event_type", [F.desc("event_id")], 1000).groupBy("event_type").agg(n_rows().alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query("w14_score_bands", """WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS k FROM lineitem),
  b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, k, l_quantity AS top, 1 AS band FROM r WHERE k = 1 UNION ALL
    SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_quantity, r.k, CASE WHEN b.top - r.l_quantity <= 5 THEN b.top ELSE r.l_quantity END, CASE WHEN b.top - r.l_quantity <= 5 THEN b.band ELSE b.band + 1 END FROM b JOIN r ON r.l_orderkey = b.l_orderkey AND r.k = b.k + 1)
  SELECT l_orderkey, l_linenumber, l_partkey, band FROM b""")
def w14(spark, d):
    """Rows within 5 of their band's top form a band; the next one begins with the first beyond."""
    row = F.struct((-F.col("l_quantity")).alias("minus"), "l_linenumber", "l_partkey")
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return sequences.bands(lists, "l_orderkey", "rows", 5.0).select("l_orderkey", "l_linenumber", "l_partkey", "band")


@query("w18_drift_runs", """WITH m AS (SELECT user_id, event_id, lag(event_id) OVER w IS NOT NULL AND event_type <> lag(event_type) OVER w AND abs(value - lag(value) OVER w) > 1 AND (user_id + event_id) % 3 <> (user_id + lag(event_id) OVER w) % 3 AS drift FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  g AS (SELECT *, sum(CASE WHEN drift THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, event_id FROM (SELECT *, sum(CASE WHEN drift THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS length FROM g) WHERE drift AND length = 3""")
def w18(spark, d):
    """Rows unrelated to the one before in all three respects; the third in a row fires."""
    third = (F.col("user_id") + F.col("event_id")) % 3
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 1000).alias("stretch"), F.struct("event_type", "value", third.alias("third")).alias("row"))
    old, row = F.col("previous.value"), F.col("row")
    drift = old.isNotNull() & (row["event_type"] != old["event_type"]) & (F.abs(row["value"] - old["value"]) > 1) & (row["third"] != old["third"])
    m = sequences.in_runs(rows, "user_id", "stretch", ["event_id"], "row").select("user_id", "event_id", "stretch", F.coalesce(drift, F.lit(False)).alias("drift"))
    return sequences.in_runs(m, "user_id", "stretch", ["event_id"], "drift").where("drift AND before = 2").select("user_id", "event_id")


@query("w17_flagged_runs", """WITH m AS (SELECT user_id, event_id, event_type, coalesce(value > 250, false) AS high, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, high ORDER BY event_id) AS a, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS b FROM m),
  f AS (SELECT user_id, event_id, high AND count(*) OVER (PARTITION BY user_id, high, a) >= 3 AS overload, event_type NOT IN ('error', 'signup') AND count(*) OVER (PARTITION BY user_id, event_type, b) >= 4 AS repetitive FROM g)
  SELECT * FROM f WHERE overload OR repetitive""")
def w17(spark, d):
    """Every row of a run of three or more high values, and of four or more equal kinds; runs of two of the kinds don't count."""
    high = F.coalesce(F.col("value") > 250, F.lit(False))
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.floor(F.col("event_id") / 1000).alias("stretch"), high.alias("high"))
    highs = sequences.in_runs(rows, "user_id", "stretch", ["event_id"], "high").withColumn("overload", F.col("high") & (F.col("run_length") >= 3))
    kinds = sequences.in_runs(highs.drop("previous", "before", "run_length"), "user_id", "stretch", ["event_id"], "event_type")
    repetitive = ~F.col("event_type").isin("error", "signup") & (F.col("run_length") >= 4)
    return kinds.select("user_id", "event_id", "overload", repetitive.alias("repetitive")).where("overload OR repetitive")


@query("w19_broken_runs", """WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), o AS (SELECT ['click', 'view', 'signup'] AS alt),
  s AS (SELECT user_id, event_id, k, event_type AS value, 1 AS run, 0 AS used FROM r WHERE k = 1 UNION ALL
    SELECT r.user_id, r.event_id, r.k, CASE WHEN r.event_type = s.value AND s.run >= 2 THEN CASE WHEN alt[s.used % 3 + 1] = r.event_type THEN alt[(s.used + 1) % 3 + 1] ELSE alt[s.used % 3 + 1] END ELSE r.event_type END,
      CASE WHEN r.event_type = s.value AND s.run < 2 THEN s.run + 1 ELSE 1 END, CASE WHEN r.event_type = s.value AND s.run >= 2 THEN s.used + 1 ELSE s.used END FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1, o)
  SELECT user_id, event_id, value FROM s""")
def w19(spark, d):
    """The third of equal values is replaced from a rotating list; what comes after is compared with the replacement."""
    lists = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("rows"))
    return sequences.broken_runs(lists, "user_id", "rows", 2, ["click", "view", "signup"]).select("user_id", "event_id", "value")
