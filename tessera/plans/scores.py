"""Ranking, scoring, scalar functions and the batch forms of continuous queries of the survey, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import ranking, sequences
from tessera.plans.book import book
from tessera.sources.tables import table

QUERIES, ORACLES, query = book()


def n_rows() -> Column:
    return F.count(F.lit(1))

#: The weights of the four base signals and of the eight optional ones.
BASE = {"clip": 0.22, "embedding": 0.15, "keyword": 0.09, "source": 0.07}
OPTIONAL = {"editorial": 0.10, "motion": 0.05, "resolution": 0.04, "orientation": 0.03, "duration": 0.05, "freshness": 0.02, "entity": 0.08, "diversity": 0.10}

_SIGNALS = """SELECT p_partkey, p_size % 5 AS beat, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey * 37 % 101) / 100 END AS clip, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey * 53 % 101) / 100 END AS embedding,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS kw, CASE WHEN p_brand LIKE '%1%' THEN 100 WHEN p_brand LIKE '%2%' THEN 80 ELSE 0 END / 100 AS source,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE least(1, p_size * 2 / 100) END AS editorial, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE exp(-((p_size * 2 - 50) * (p_size * 2 - 50)) / (2.0 * 30 * 30)) END AS motion,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 640 + p_partkey % 7 * 320 END AS w, 360 + p_partkey % 5 * 240 AS h, exp(-((p_size % 12 - 6) * (p_size % 12 - 6)) / (2.0 * 3 * 3)) AS duration,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE greatest(0, 1 - (p_partkey % 25) / 20) END AS freshness, (CAST(contains(p_name, 'red') AS INTEGER) + CAST(contains(p_name, 'ring') AS INTEGER)) / 2 AS entity,
  CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE greatest(0, 1 - 0.15 * (p_size % 4)) END AS diversity FROM part"""


def signals(spark, d):
    """Candidates with the raw values of the twelve signals; some are missing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    some = lambda n, c: F.when(k % n != 0, c)
    has = lambda w: F.contains("p_name", F.lit(w)).cast("int")
    return table(spark, d, "part").select(
        "p_partkey", (size % 5).alias("beat"), some(5, k * 37 % 101 / 100).alias("clip"), some(7, k * 53 % 101 / 100).alias("embedding"), some(3, F.col("p_retailprice")).alias("kw"),
        (F.when(F.col("p_brand").contains("1"), 100).when(F.col("p_brand").contains("2"), 80).otherwise(0) / 100).alias("source"),
        some(4, F.least(F.lit(1.0), size * 2 / 100)).alias("editorial"), some(6, ranking.gaussian(size * 2, 50, 30)).alias("motion"), some(11, 640 + k % 7 * 320).alias("w"), (360 + k % 5 * 240).alias("h"),
        ranking.gaussian(size % 12, 6, 3).alias("duration"), some(9, F.greatest(F.lit(0.0), 1 - k % 25 / 20)).alias("freshness"), ((has("red") + has("ring")) / 2).alias("entity"),
        F.when(k % 13 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.15 * (size % 4))).alias("diversity"))


_SHAPE = "CASE WHEN w IS NULL THEN NULL WHEN w / h > 1.15 THEN 1 WHEN w / h < 0.87 THEN 0 ELSE 0.5 END"


@query("r01_weighted_rank_full", f"""WITH s AS ({_SIGNALS}), m AS (SELECT beat, min(kw) AS lo, max(kw) AS hi FROM s GROUP BY beat),
  v AS (SELECT s.*, CASE WHEN kw IS NULL THEN 0 WHEN hi = lo THEN 1 ELSE (kw - lo) / (hi - lo) END AS keyword, CASE WHEN w IS NULL THEN NULL ELSE least(1, least(w, h) / 1080) END AS resolution, {_SHAPE} AS orientation FROM s JOIN m ON s.beat = m.beat),
  t AS (SELECT p_partkey, beat, (0.22 * coalesce(clip, 0) + 0.15 * coalesce(embedding, 0) + 0.09 * keyword + 0.07 * source) * (1 + (CASE WHEN editorial IS NULL THEN 0.10 ELSE 0 END + CASE WHEN motion IS NULL THEN 0.05 ELSE 0 END + CASE WHEN resolution IS NULL THEN 0.04 ELSE 0 END
    + CASE WHEN orientation IS NULL THEN 0.03 ELSE 0 END + CASE WHEN freshness IS NULL THEN 0.02 ELSE 0 END) / 0.53) + 0.10 * coalesce(editorial, 0) + 0.05 * coalesce(motion, 0) + 0.04 * coalesce(resolution, 0) + 0.03 * coalesce(orientation, 0) + 0.05 * duration + 0.02 * coalesce(freshness, 0) + 0.08 * entity + 0.10 * diversity AS score FROM v)
  SELECT beat, p_partkey, round(score, 6) AS score, row_number() OVER (PARTITION BY beat ORDER BY round(score, 9) DESC, p_partkey) AS place FROM t""")
def r01(spark, d):
    """All twelve signals: base ones count 0 where missing, the weight of missing optional ones goes to the base in proportion; then the
    rank in the beat. The keyword scores are scaled over the beat, whose extremes are aggregated before they are joined."""
    s = signals(spark, d)
    ends = s.groupBy("beat").agg(F.min("kw").alias("lo"), F.max("kw").alias("hi"))
    s = s.join(ends, "beat").withColumn("keyword", N.scaled(F.col("kw"), F.col("lo"), F.col("hi")))
    s = s.withColumns({"resolution": N.resolution(F.col("w"), F.col("h")), "orientation": N.orientation_match(F.col("w"), F.col("h"), "landscape")})
    base, optional = ([(F.col(k), w) for k, w in x.items()] for x in (BASE, OPTIONAL))
    scored = s.withColumn("score", ranking.redistributed(base, optional))
    by = Window.partitionBy("beat").orderBy(F.desc(F.round("score", 9)), "p_partkey")
    return scored.select("beat", "p_partkey", F.round("score", 6).alias("score"), F.row_number().over(by).cast("long").alias("place"))


@query("r03_resolution_orientation", f"WITH s AS ({_SIGNALS}) SELECT p_partkey, round(CASE WHEN w IS NULL THEN NULL ELSE least(1, least(w, h) / 1080) END, 6) AS resolution, CASE WHEN w IS NULL THEN NULL WHEN w / h > 1.15 THEN 'landscape' WHEN w / h < 0.87 THEN 'portrait' ELSE 'square' END AS orientation, CAST({_SHAPE} AS DOUBLE) AS match FROM s")
def r03(spark, d):
    w, h = F.col("w"), F.col("h")
    return signals(spark, d).select("p_partkey", F.round(N.resolution(w, h), 6).alias("resolution"), N.orientation(w, h).alias("orientation"), N.orientation_match(w, h, "landscape").alias("match"))


@query("r04_freshness", "SELECT event_id, round(greatest(0, least(1, 1 - date_diff('second', ts, TIMESTAMP '2030-01-01') / (365 * 86400) / 20)), 6) AS freshness FROM events")
def r04(spark, d):
    """1 for today, down to 0 in 20 years; from the first of several texts that is a date."""
    rows = table(spark, d, "events").select("event_id", F.lit("unknown").alias("published"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("uploaded"))
    when = F.coalesce(F.try_to_timestamp("published"), F.try_to_timestamp("uploaded"))
    years = (F.unix_timestamp(F.lit("2030-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp(when)) / (365 * 86400)
    return rows.select("event_id", F.round(N.clamp(1 - years / 20), 6).alias("freshness"))


@query("r05_diversity", """WITH l AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) - 1 AS used, count(*) OVER (PARTITION BY l_orderkey, p_type ORDER BY l_linenumber) - 1 AS a, count(*) OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_linenumber) - 1 AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN used > 0 THEN 0 ELSE greatest(0, 1 - 0.15 * greatest(a, b)) END, 6) AS diversity FROM l""")
def r05(spark, d):
    """Within an order: 0 for a part that an earlier line used, else less for each earlier use of its most used tag (type or brand)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    before = lambda c: n_rows().over(Window.partitionBy("l_orderkey", c).orderBy("l_linenumber")) - 1
    rest = N.clamp(1 - 0.15 * F.greatest(before("p_type"), before("p_brand")))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.when(before("p_partkey") > 0, 0.0).otherwise(rest), 6).alias("diversity"))


@query("r07_verdicts", """WITH c AS (SELECT l_orderkey AS beat, l_partkey, l_linenumber, floor(l_extendedprice / 1000) AS score, l_quantity AS rank_score, l_suppkey % 3 AS priority FROM lineitem),
  t AS (SELECT *, CASE WHEN score >= 85 THEN 'perfect' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'acceptable' ELSE 'reject' END AS tier FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY beat ORDER BY score DESC, rank_score DESC, priority DESC, l_partkey, l_linenumber) AS k, max(score) OVER (PARTITION BY beat) AS best FROM t)
  SELECT beat, l_partkey, l_linenumber, tier, round(least(1, score / 100), 6) AS confidence, CASE WHEN tier = 'reject' THEN CASE WHEN best < 50 THEN 'no winner: all below the least tier' ELSE 'below the least tier' END WHEN k = 1 THEN 'winner' WHEN score = best THEN 'lost the tie' ELSE 'lower score' END AS verdict FROM r""")
def r07(spark, d):
    """A verdict on every candidate: the winner by five keys, why the others lost, and why there is none."""
    score = F.floor(F.col("l_extendedprice") / 1000)
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("beat"), "l_partkey", "l_linenumber", score.alias("score"), F.col("l_quantity").alias("rank_score"), (F.col("l_suppkey") % 3).alias("priority"))
    by = Window.partitionBy("beat")
    rows = rows.withColumns({"k": F.row_number().over(by.orderBy(F.desc("score"), F.desc("rank_score"), F.desc("priority"), "l_partkey", "l_linenumber")), "best": F.max("score").over(by)})
    tier = F.when(F.col("score") >= 85, "perfect").when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "acceptable").otherwise("reject")
    below = F.when(F.col("best") < 50, "no winner: all below the least tier").otherwise("below the least tier")
    verdict = F.when(tier == "reject", below).when(F.col("k") == 1, "winner").when(F.col("score") == F.col("best"), "lost the tie").otherwise("lower score")
    return rows.select("beat", "l_partkey", "l_linenumber", tier.alias("tier"), F.round(N.clamp(F.col("score") / 100), 6).alias("confidence"), verdict.alias("verdict"))


@query("r08_source_strategy", """WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') / count(*) AS coverage FROM orders GROUP BY o_custkey)
  SELECT o_custkey, round(coverage, 6) AS coverage, CASE WHEN coverage > 0.88 THEN 'archive' WHEN coverage > 0.45 THEN 'mixed' ELSE 'internet' END AS strategy, CASE WHEN coverage > 0.88 THEN 1.0 WHEN coverage > 0.45 THEN 0.7 ELSE 0.3 END::DOUBLE AS archive_weight, CASE WHEN coverage > 0.88 THEN 0.3 WHEN coverage > 0.45 THEN 0.7 ELSE 1.0 END::DOUBLE AS internet_weight FROM c""")
def r08(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") == "F") / n_rows()).alias("c"))
    pick = lambda *v: F.when(F.col("c") > 0.88, v[0]).when(F.col("c") > 0.45, v[1]).otherwise(v[2])
    return c.select("o_custkey", F.round("c", 6).alias("coverage"), pick("archive", "mixed", "internet").alias("strategy"), pick(1.0, 0.7, 0.3).alias("archive_weight"), pick(0.3, 0.7, 1.0).alias("internet_weight"))


@query("r09_merge_rank", """WITH a AS (SELECT p_partkey AS id, p_size % 6 AS beat, 'archive' AS source, (least(1, p_size / 40) + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 0.4 * (p_partkey % 10) / 10 END + CASE WHEN p_type = 'PROMO' THEN 0.15 ELSE 0 END) * 0.7 AS s FROM part WHERE p_brand LIKE '%1%'),
  e AS (SELECT p_partkey AS id, p_size % 6 AS beat, p_brand AS source, 0.7 * (0.7 + CASE WHEN p_brand LIKE '%2%' THEN 0.12 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 0.15 ELSE 0 END) AS s FROM part WHERE p_size >= 10),
  u AS (SELECT id, beat, arg_min(source, o) AS source, arg_min(s, o) AS s FROM (SELECT *, 1 AS o FROM a UNION ALL SELECT *, 2 FROM e) GROUP BY id, beat), r AS (SELECT *, row_number() OVER (PARTITION BY beat ORDER BY round(s, 9) DESC, id) AS place FROM u)
  SELECT beat, id, source, round(s, 6) AS score, place FROM r WHERE place <= 40""")
def r09(spark, d):
    """Two sources, each with its own score and weight; what both have counts as the archive's; the best forty."""
    part = table(spark, d, "part").withColumn("beat", F.col("p_size") % 6).withColumn("moving", F.when(F.col("p_type") == "PROMO", 0.15).otherwise(0.0))
    own = (F.least(F.lit(1.0), F.col("p_size") / 40) + F.when(F.col("p_partkey") % 4 != 0, 0.4 * (F.col("p_partkey") % 10) / 10).otherwise(0.0) + F.col("moving")) * 0.7
    other = 0.7 * (0.7 + F.when(F.col("p_brand").contains("2"), 0.12).otherwise(0.0) + F.col("moving"))
    pool = lambda where, o, source, s: part.where(where).select(F.col("p_partkey").alias("id"), "beat", F.struct(F.lit(o).alias("o"), source.alias("source"), s.alias("s")).alias("x"))
    both = pool("p_brand LIKE '%1%'", 1, F.lit("archive"), own).unionByName(pool("p_size >= 10", 2, F.col("p_brand"), other))
    first = both.groupBy("id", "beat").agg(F.min("x").alias("x")).select("beat", "id", "x.source", "x.s")
    return ranking.top(first, "beat", [F.desc(F.round("s", 9)), F.col("id")], 40).select("beat", "id", "source", F.round("s", 6).alias("score"), "place")


@query("r12_gap_strategy", "SELECT p_partkey, CASE WHEN p_retailprice / 2000 > 0.94 AND p_size % 4 < 2 THEN 'archive only' WHEN p_retailprice / 2000 > 0.75 THEN 'archive first' WHEN p_retailprice / 2000 > 0.5 THEN 'mixed' ELSE 'external' END AS strategy FROM part")
def r12(spark, d):
    """By coverage; no third archive-only beat in a row (the number of those before is given)."""
    c, before = F.col("p_retailprice") / 2000, F.col("p_size") % 4
    strategy = F.when((c > 0.94) & (before < 2), "archive only").when(c > 0.75, "archive first").when(c > 0.5, "mixed").otherwise("external")
    return table(spark, d, "part").select("p_partkey", strategy.alias("strategy"))


@query("r13_class_order", "SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN (p_brand LIKE '%1%') = (p_size % 2 = 0) THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS place FROM part")
def r13(spark, d):
    """One class before the other, by score within."""
    first = F.when(F.col("p_brand").contains("1") == (F.col("p_size") % 2 == 0), 0).otherwise(1)
    by = Window.partitionBy("p_size").orderBy(first, F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_size", "p_partkey", F.row_number().over(by).cast("long").alias("place"))


@query("r14_token_hits", """WITH s AS (SELECT p_partkey, p_size, 3 * (CAST(contains(p_name, 'ring') AS INTEGER) + CAST(contains(p_name, 'red') AS INTEGER)) + 2 * (CAST(contains(lower(p_type), 'ring') AS INTEGER) + CAST(contains(lower(p_type), 'red') AS INTEGER)) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY score DESC, p_partkey) AS place FROM s)
  SELECT p_size, p_partkey, score, place FROM r WHERE place <= 5 AND score > 0""")
def r14(spark, d):
    """Three for each word in the title, two for each in a tag; the best five."""
    words = F.array(F.lit("ring"), F.lit("red"))
    hits = lambda text: F.size(F.filter(words, lambda w: F.contains(text, w)))
    rows = table(spark, d, "part").select("p_partkey", "p_size", (3 * hits(F.col("p_name")) + 2 * hits(F.lower("p_type"))).alias("score"))
    return ranking.top(rows, "p_size", [F.desc("score"), F.col("p_partkey")], 5).where("score > 0").select("p_size", "p_partkey", "score", "place")


@query("r15_media_score", """SELECT p_partkey, CASE WHEN p_brand LIKE '%1%' THEN 30 WHEN p_brand LIKE '%2%' THEN 22 ELSE 10 END + CASE WHEN p_type = 'ECONOMY' THEN 8 ELSE 0 END + 3 * CAST(contains(p_name, 'small') AS INTEGER) + 2 * CAST(contains(p_name, 'ring') AS INTEGER) + CAST(contains(lower(p_type), 'promo') AS INTEGER) + CASE WHEN p_size > 40 THEN -6 ELSE 0 END AS score FROM part""")
def r15(spark, d):
    """The source's base, topic, keywords by three weights, and flags."""
    has = lambda c, w: F.contains(c, F.lit(w)).cast("int")
    brand = F.col("p_brand")
    base = F.when(brand.contains("1"), 30).when(brand.contains("2"), 22).otherwise(10)
    score = base + F.when(F.col("p_type") == "ECONOMY", 8).otherwise(0) + 3 * has("p_name", "small") + 2 * has("p_name", "ring") + has(F.lower("p_type"), "promo") + F.when(F.col("p_size") > 40, -6).otherwise(0)
    return table(spark, d, "part").select("p_partkey", score.alias("score"))


@query("r16_dedup_score_sort", """WITH f AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name) SELECT f.p_name, f.p_partkey, p.p_size * 2 + length(p.p_name) AS score, row_number() OVER (ORDER BY p.p_size * 2 + length(p.p_name) DESC, f.p_partkey) AS place FROM f JOIN part p ON f.p_partkey = p.p_partkey""")
def r16(spark, d):
    """One row a path, scored, in one order of all: equal scores are counted first, so that no task sorts all paths."""
    first = table(spark, d, "part").groupBy("p_name").agg(F.min(F.struct("p_partkey", "p_size")).alias("x")).select("p_name", "x.*")
    scored = first.select("p_name", "p_partkey", (F.col("p_size") * 2 + F.length("p_name")).alias("score")).withColumn("minus", -F.col("score"))
    return sequences.numbered(scored, [], "minus", ["minus", "p_partkey"], "place").drop("minus")


@query("r17_tiered_relevance", """WITH h AS (SELECT doc_id, lower(coalesce(text, '')) AS hay, doc_id % 2 = 0 AS video FROM documents), t AS (SELECT *, len(list_filter([' the ', ' and '], lambda x: contains(hay, x))) AS t1, len(list_filter([' la ', ' de '], lambda x: contains(hay, x))) AS t2, len(list_filter(['http', '@'], lambda x: contains(hay, x))) AS t3, len(list_filter(['password', 'license', 'and'], lambda x: contains(hay, x))) AS m FROM h),
  s AS (SELECT *, CASE WHEN t1 > 0 THEN 92 + least(8, 3 * t1) WHEN t2 > 0 THEN 78 + least(8, 3 * t2) WHEN t3 > 0 THEN 65 + least(8, 3 * t3) ELSE 18 END + CASE WHEN m >= 2 THEN 10 ELSE 0 END + CASE WHEN m >= 3 THEN 6 ELSE 0 END AS a, CASE WHEN t1 > 0 THEN 1 WHEN t2 > 0 THEN 2 WHEN t3 > 0 THEN 3 ELSE 5 END AS tier FROM t),
  c AS (SELECT *, CASE WHEN m = 0 AND tier >= 4 THEN least(a, 22) ELSE a END AS b FROM s) SELECT doc_id, tier, greatest(0, least(100, b + CASE WHEN video AND b >= 50 THEN 4 ELSE 0 END)) AS relevance FROM c""")
def r17(spark, d):
    """The first tier with a hit sets the base; entities add, a missing one caps, moving pictures add a little."""
    hay = F.lower(F.coalesce("text", F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", hay.alias("hay"), (F.col("doc_id") % 2 == 0).alias("video"))
    tiers = [[" the ", " and "], [" la ", " de "], ["http", "@"]]
    scored = rows.select("doc_id", "video", N.tiered(F.col("hay"), tiers).alias("t"), N.hits(F.col("hay"), ["password", "license", "and"]).alias("m"))
    return scored.select("doc_id", F.col("t.tier").alias("tier"), N.relevance(F.col("t.tier"), F.col("t.base"), F.col("m"), F.col("video")).alias("relevance"))


@query("r18_lexical_cosine", """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, 3 AS x FROM part UNION ALL SELECT p_partkey, lower(p_type), 1 FROM part), q(w, y) AS (VALUES ('red', 2), ('ring', 3), ('economy', 1)), v AS (SELECT p_partkey, w, sum(x) AS x FROM w GROUP BY ALL),
  n AS (SELECT p_partkey, sqrt(sum(x * x)) AS n FROM v GROUP BY p_partkey), s AS (SELECT p_partkey, sum(x * y) AS s FROM v JOIN q ON v.w = q.w GROUP BY p_partkey) SELECT n.p_partkey, round(coalesce(s, 0) / n / sqrt(14), 6) AS cosine, floor(0.58 * 65 + 0.42 * floor(100 * round(coalesce(s, 0) / n / sqrt(14), 6) + 0.5) + 0.5) AS blend FROM n LEFT JOIN s ON n.p_partkey = s.p_partkey""")
def r18(spark, d):
    """R-18 and R-19: the cosine of weighted words with a query's, and its blend with a tier. The query's words are a literal; a row's own
    words never leave it."""
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    weight = F.concat(F.transform(F.split("p_name", " "), lambda w: F.lit(3)), F.array(F.lit(1)))
    cosine = T.weighted_cosine(words, weight, {"red": 2, "ring": 3, "economy": 1})
    rows = table(spark, d, "part").select("p_partkey", F.round(cosine, 6).alias("cosine"))
    return rows.withColumn("blend", F.floor(0.58 * 65 + 0.42 * F.floor(100 * F.col("cosine") + 0.5) + 0.5).cast("double"))


@query("r23_embedding_ladder", "WITH s AS (SELECT p_partkey, p_retailprice / 2000 AS x FROM part) SELECT p_partkey, round(CASE WHEN x <= 0.2 THEN 0 WHEN x <= 0.5 THEN (x - 0.2) / 0.3 * 50 WHEN x <= 0.8 THEN 50 + (x - 0.5) / 0.3 * 40 ELSE 90 + least(10, (x - 0.8) / 0.2 * 10) END, 6) AS score FROM s")
def r23(spark, d):
    x = F.col("p_retailprice") / 2000
    return table(spark, d, "part").select("p_partkey", F.round(ranking.interpolate(x, [(0.2, 0), (0.5, 50), (0.8, 90), (1.0, 100)]), 6).alias("score"))


@query("r25_segment_bonus", """WITH s AS (SELECT l_orderkey, arg_max(l_linenumber, (l_discount, -l_linenumber)) AS segment, max(l_discount) AS best, avg(l_discount) AS clip FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, segment, least(6, floor(greatest(0, round(best - clip, 9)) / 0.005)) AS bonus FROM s""")
def r25(spark, d):
    """The best segment over the clip as a whole, a point for each step, six at most."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_discount", -F.col("l_linenumber"))).alias("segment"), F.max("l_discount").alias("best"), F.avg("l_discount").alias("clip"))
    return s.select("l_orderkey", "segment", F.least(F.lit(6.0), F.floor(F.greatest(F.lit(0.0), F.round(F.col("best") - F.col("clip"), 9)) / 0.005).cast("double")).alias("bonus"))


@query("r26_adoption_boost", """WITH g AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), t AS (SELECT p_type AS k, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1)
  SELECT p_partkey, greatest(least(18, coalesce(g.n, 0)), CASE WHEN t.n > 3000 THEN 6 ELSE 0 END, CASE WHEN p_name LIKE '%ring%' THEN 3 ELSE 0 END) AS boost FROM part LEFT JOIN g ON p_partkey = g.k LEFT JOIN t ON p_type = t.k""")
def r26(spark, d):
    """The largest of three boosts: for the clip itself, its kind, and its topic."""
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_name")
    adopted = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(n_rows().alias("n"))
    rows = part.join(adopted, "p_partkey", "left")
    kinds = rows.groupBy("p_type").agg(F.sum("n").alias("kind"))
    boost = F.greatest(F.least(F.lit(18), F.coalesce("n", F.lit(0))), F.when(F.col("kind") > 3000, 6).otherwise(0), F.when(F.col("p_name").contains("ring"), 3).otherwise(0))
    return rows.join(kinds, "p_type").select("p_partkey", boost.alias("boost"))


@query("r27_ai_rerank", """SELECT p.p_partkey, p_size + coalesce(greatest(0, least(10, a.q)) * 6, 0) AS score FROM part p LEFT JOIN (SELECT l_partkey, max(l_linenumber * 2) AS q FROM lineitem WHERE l_quantity > 48 GROUP BY l_partkey) a ON p_partkey = l_partkey""")
def r27(spark, d):
    """A second opinion adds up to 60; without one the score stays."""
    second = table(spark, d, "lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_linenumber") * 2).alias("q"))
    return table(spark, d, "part").join(second, "p_partkey", "left").select("p_partkey", (F.col("p_size") + F.coalesce(F.greatest(F.lit(0), F.least(F.lit(10), "q")) * 6, F.lit(0))).alias("score"))


@query("r28_scored_first", "SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END DESC NULLS LAST, p_partkey) AS place FROM part")
def r28(spark, d):
    """Scored ones by score, then the others as they came."""
    score = F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice"))
    by = Window.partitionBy("p_size").orderBy(score.desc_nulls_last(), "p_partkey")
    return table(spark, d, "part").select("p_size", "p_partkey", F.row_number().over(by).cast("long").alias("place"))


@query("r29_clip_top_n", """WITH r AS (SELECT p_size, p_partkey, p_retailprice / 2000 AS s, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part) SELECT p_size, p_partkey, k <= greatest(3, ceil(n * 0.25)) AND s >= 0.6 AS passed FROM r""")
def r29(spark, d):
    """The best quarter (three at least) with the least similarity passes; the others come back as rejected."""
    by = Window.partitionBy("p_size")
    k, n = F.row_number().over(by.orderBy(F.desc("p_retailprice"), "p_partkey")), F.count(F.lit(1)).over(by)
    return table(spark, d, "part").select("p_size", "p_partkey", ((k <= F.greatest(F.lit(3), F.ceil(n * 0.25))) & (F.col("p_retailprice") / 2000 >= 0.6)).alias("passed"))


@query("r33_source_priority", "WITH s AS (SELECT event_type, count(*) * CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 ELSE 1 END AS w FROM events GROUP BY event_type) SELECT event_type, w, row_number() OVER (ORDER BY w DESC, event_type) AS place FROM s")
def r33(spark, d):
    """Sources (a closed set) by weight."""
    weight = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "signup", 3).otherwise(1)
    s = table(spark, d, "events").groupBy("event_type").agg((n_rows() * F.first(weight)).alias("w"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("w"), "event_type")).cast("long"))


@query("r34_history_blend", """WITH h AS (SELECT l_partkey, avg(l_quantity) AS a, count(*) AS n FROM lineitem WHERE l_shipdate < DATE '1998-01-01' GROUP BY l_partkey)
  SELECT p_partkey, round(CASE WHEN n >= 3 AND a BETWEEN 0.6 * 25 AND 1.4 * 25 THEN 0.7 * 25 + 0.3 * a ELSE 25 END, 6) AS budget FROM part LEFT JOIN h ON p_partkey = l_partkey""")
def r34(spark, d):
    """Seven parts estimate and three parts history, where history is within 40 % of it."""
    h = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("a"), n_rows().alias("n"))
    sane = (F.col("n") >= 3) & F.col("a").between(0.6 * 25, 1.4 * 25)
    return table(spark, d, "part").select("p_partkey").join(h, "p_partkey", "left").select("p_partkey", F.round(F.when(sane, 0.7 * 25 + 0.3 * F.col("a")).otherwise(25.0), 6).alias("budget"))


@query("r36_weakest_dimensions", """WITH s AS (SELECT user_id, event_type, round(avg(value), 6) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, event_type) AS k FROM s) SELECT user_id, list(event_type ORDER BY k) AS weakest FROM r WHERE k <= 3 GROUP BY user_id""")
def r36(spark, d):
    """The three lowest dimensions, lowest first."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"))
    low = ranking.top(s, "user_id", [F.col("score"), F.col("event_type")], 3)
    return low.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_type"))), lambda x: x["event_type"]).alias("weakest"))


@query("r37_adapted_blend", """WITH w(kind, a, b) AS (VALUES ('ECONOMY', 0.7, 0.3), ('PROMO', 0.4, 0.6), ('STANDARD', 0.5, 0.5)) SELECT p_partkey, round(greatest(0, least(100, coalesce(a, 0.6) * p_size * 2 + coalesce(b, 0.4) * p_retailprice / 20 - CASE WHEN p_name LIKE '%small%' THEN 7 ELSE 0 END + CASE WHEN p_brand LIKE '%1%' THEN 5 ELSE 0 END)), 6) AS taste FROM part LEFT JOIN w ON p_type = kind""")
def r37(spark, d):
    """Weights by the kind of document, penalties, a bonus of the source, and bounds."""
    w = spark.createDataFrame([("ECONOMY", 0.7, 0.3), ("PROMO", 0.4, 0.6), ("STANDARD", 0.5, 0.5)], "p_type string, a double, b double")
    rows = table(spark, d, "part").join(F.broadcast(w), "p_type", "left")
    blend = F.coalesce("a", F.lit(0.6)) * F.col("p_size") * 2 + F.coalesce("b", F.lit(0.4)) * F.col("p_retailprice") / 20
    score = blend - F.when(F.col("p_name").contains("small"), 7).otherwise(0) + F.when(F.col("p_brand").contains("1"), 5).otherwise(0)
    return rows.select("p_partkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 6).alias("taste"))


_ARC = ["view", "click", "signup", "purchase"]


@query("r38_progression", f"""WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i, lag(event_type) OVER w AS old, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS before, list_position({_ARC}, event_type) AS here, list_position({_ARC}, old) AS prior FROM b)
  SELECT user_id, event_id, CASE WHEN here IS NULL OR here = 0 THEN 60 WHEN before >= 3 THEN 10 WHEN before = 2 THEN 30 WHEN before = 1 THEN 55 WHEN prior IS NULL OR prior = 0 THEN 70
    WHEN here - prior = 1 THEN 100 WHEN here - prior = 2 THEN 85 WHEN here - prior = -1 THEN 75 WHEN here - prior > 2 THEN 60 WHEN here - prior < -1 THEN 45 ELSE 70 END AS score FROM c""")
def r38(spark, d):
    """A score for the step from the level before, and less for each equal one directly before it. 10, 30 and 55 for three,
    two and one of these; 100, 85, 75, 60 and 45 for steps of 1, 2, -1, more and less; 60 off the scale, 70 without one before."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.floor(F.col("event_id") / 1000).alias("stretch"))
    runs = sequences.in_runs(rows, "user_id", "stretch", ["event_id"], "event_type")
    level = lambda c: F.nullif(F.array_position(F.array(*map(F.lit, _ARC)), c), F.lit(0))
    here, prior, before = level(F.col("event_type")), level(F.col("previous.value")), F.col("before")
    step = here - prior
    repeated = F.when(here.isNull(), 60).when(before >= 3, 10).when(before == 2, 30).when(before == 1, 55).when(prior.isNull(), 70)
    return runs.select("user_id", "event_id", repeated.when(step == 1, 100).when(step == 2, 85).when(step == -1, 75).when(step > 2, 60).when(step < -1, 45).otherwise(70).alias("score"))


@query("r40_contract_match", """WITH h AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS hay FROM part) SELECT p_partkey, greatest(-4, least(5, 2 * len(list_filter(['ring', 'red'], lambda w: contains(hay, w))) + len(list_filter(['small', 'bolt'], lambda w: contains(hay, w))) + CASE WHEN contains(hay, 'promo') THEN 1 ELSE 0 END - 2 * len(list_filter(['economy', 'blue'], lambda w: contains(hay, w))))) AS match FROM h""")
def r40(spark, d):
    """What must, should and must not be there, within bounds."""
    hay = F.concat_ws(" ", "p_name", F.lower("p_type"))
    h = lambda *words: N.hits(hay, list(words))
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(-4), F.least(F.lit(5), 2 * h("ring", "red") + h("small", "bolt") + h("promo") - 2 * h("economy", "blue"))).cast("long").alias("match"))
