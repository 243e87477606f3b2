"""Sequential choices and routing scores of the survey over the driver's tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.operators import directing
from tessera.plans.book import book
from tessera.sources.tables import table

QUERIES, ORACLES, query = book()


@query("r32_interleave", """WITH RECURSIVE c AS (SELECT o_custkey, [count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P')] AS r FROM orders GROUP BY o_custkey),
  s AS (SELECT o_custkey, r, 0::BIGINT AS last, '' AS plan FROM c UNION ALL SELECT o_custkey, list_transform([1, 2, 3], lambda i: r[i] - CASE WHEN i = k THEN 1 ELSE 0 END), k, plan || ['F', 'O', 'P'][k]
    FROM (SELECT *, coalesce(list_sort(list_transform(list_filter([1, 2, 3], lambda i: r[i] > 0 AND i <> last), lambda i: [-r[i], i]))[1][2], list_sort(list_transform(list_filter([1, 2, 3], lambda i: r[i] > 0), lambda i: [-r[i], i]))[1][2]) AS k FROM s WHERE list_sum(r) > 0))
  SELECT o_custkey, plan FROM s WHERE list_sum(r) = 0""")
def r32(spark, d):
    """Kinds in turn without equal neighbours, where that can be: always the one with most left, the first of these among equals. Only
    counts are gathered for a key."""
    kinds = ["F", "O", "P"]
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.array(*(F.count_if(F.col("o_orderstatus") == k) for k in kinds)).alias("r"))
    return counts.select("o_custkey", directing.interleaved(F.col("r"), kinds).alias("plan"))


_CATS = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"
_SCORE = lambda k: f"""CASE WHEN {k} = pos % 4 AND NOT (pos = 0 AND opening) THEN 10 ELSE 0 END - CASE WHEN p1 = {k} THEN 5 + CASE WHEN p2 = {k} THEN 15 ELSE 0 END + {8 if k == 3 else 0} ELSE 0 END + CASE WHEN pos > 0 THEN 0 WHEN opening THEN {(4, 4, 9, -4)[k]} ELSE {(8, 8, -10, 0)[k]} END"""
_HEADS = ", ".join(f"{{'s': -({_SCORE(k)}), 'e': q[{k + 1}][done[{k + 1}] + 1], 'k': {k}}}" for k in range(4))


@query("r30_greedy_sequence", f"""WITH RECURSIVE f AS (SELECT user_id, user_id % 2 = 0 AS opening, [{", ".join(f"coalesce(list(event_id ORDER BY event_id) FILTER ({_CATS} = {k}), [])" for k in range(4))}] AS q, count(*) AS n FROM events GROUP BY user_id),
  s AS (SELECT user_id, opening, n, 0 AS pos, [0, 0, 0, 0] AS done, -1 AS p1, -1 AS p2, NULL::BIGINT AS event_id FROM f UNION ALL
    SELECT user_id, opening, n, pos + 1, list_transform(done, lambda x, i: x + CASE WHEN i = best.k + 1 THEN 1 ELSE 0 END), best.k, p1, best.e FROM (SELECT s.*, list_sort(list_filter([{_HEADS}], lambda x: x.e IS NOT NULL))[1] AS best FROM s JOIN f USING (user_id, opening, n) WHERE pos < n))
  SELECT user_id, CAST(pos - 1 AS INTEGER) AS place, event_id FROM s WHERE pos > 0""")
def r30(spark, d):
    """Clips placed one after the other: each time the best by target, by the two before it and by the opening; the first among equals."""
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    rows = table(spark, d, "events").select("user_id", "event_id", kind.alias("kind"), (F.col("user_id") % 2 == 0).alias("opening"))
    return directing.placed(rows, "user_id", "kind", "opening")


@query("j17_token_cursor", r"""WITH RECURSIVE w AS (SELECT item_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM benchmark), t AS (SELECT item_id, list_filter(w, lambda x: length(x) > 1) AS w, list_transform(list_filter(list_filter(w, lambda x: length(x) > 1), lambda x, i: i % 3 = 0), lambda x: substr(x, 1, 4)) AS b FROM w),
  s AS (SELECT item_id, w, b, 0::BIGINT AS ti, 0::BIGINT AS si, []::BIGINT[] AS got FROM t UNION ALL SELECT item_id, w, b, ti + 1, si + CASE WHEN hit THEN 1 ELSE 0 END, CASE WHEN hit THEN list_append(got, ti) ELSE got END FROM (SELECT *, starts_with(w[ti + 1], b[si + 1]) OR starts_with(b[si + 1], w[ti + 1]) AS hit FROM s WHERE ti < len(w) AND si < len(b)))
  SELECT item_id, arg_max(got, ti) AS matched, max(ti) AS next FROM s GROUP BY item_id""")
def j17(spark, d):
    """A text's words in order against the next wanted one, equal or one the beginning of the other: where they matched, and where the
    cursor stands then. The wanted ones are every third word's beginning."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 1)
    wanted = F.transform(F.filter(words, lambda x, i: (i + 1) % 3 == 0), lambda x: F.substring(x, 1, 4))
    rows = table(spark, d, "benchmark").select("item_id", words.alias("w"), wanted.alias("b"))
    return rows.select("item_id", directing.cursor(F.col("w"), F.col("b")).alias("c")).select("item_id", F.col("c.got").alias("matched"), F.col("c.ti").alias("next"))


@query("j16_beat_alignment", r"""WITH RECURSIVE c AS (SELECT conv_id, list(string_split_regex(lower(coalesce(text, '')), '[^a-zà-ÿ]+') ORDER BY turn, role, text) AS segs FROM conversations GROUP BY conv_id),
  b AS (SELECT conv_id, segs, list_transform(list_filter(segs, lambda x, i: i % 2 = 1), lambda x: list_distinct(list_filter(x, lambda t: length(t) >= 5))) AS beats FROM c),
  s AS (SELECT conv_id, segs, beats, 0::BIGINT AS bi, 0::BIGINT AS pos, NULL::BIGINT AS first, NULL::BIGINT AS last FROM b UNION ALL
    SELECT conv_id, segs, beats, bi + 1, least(len(segs), best + 1), pos, best FROM (SELECT *, CASE WHEN pos >= len(segs) THEN len(segs) - 1 ELSE coalesce(list_sort(list_transform(range(pos, len(segs)), lambda j: [-len(list_filter(beats[bi + 1], lambda t: list_contains(flatten(segs[pos + 1:j + 1]), t))), j]))[1][2], pos) END AS best FROM s WHERE bi < len(beats)))
  SELECT conv_id, bi AS beat, first, last FROM s WHERE bi > 0""")
def j16(spark, d):
    """Beats in order against later segments: the shortest span from the cursor that holds most of the beat's words; the cursor goes on
    behind it."""
    tokens = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-zà-ÿ]+")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", tokens.alias("w")))), lambda x: x["w"]).alias("segs"))
    beats = F.transform(F.filter("segs", lambda x, i: i % 2 == 0), lambda x: F.array_distinct(F.filter(x, lambda t: F.length(t) >= 5)))
    return directing.aligned(rows.withColumn("beats", beats), "conv_id", "beats", "segs")


@query("x38_beats", r"""WITH RECURSIVE w AS (SELECT item_id, unnest(string_split_regex(text, '\s+')) AS w, unnest(range(1, len(string_split_regex(text, '\s+')) + 1)) AS i FROM benchmark),
  s AS (SELECT item_id, i, w, 1::BIGINT AS beat, 1::BIGINT AS first, CASE WHEN regexp_matches(w, '[.!?]$') AND 4 >= 12 THEN true ELSE false END AS ended FROM w WHERE i = 1 UNION ALL
    SELECT w.item_id, w.i, w.w, CASE WHEN s.ended THEN s.beat + 1 ELSE s.beat END, CASE WHEN s.ended THEN w.i ELSE s.first END, (regexp_matches(w.w, '[.!?]$') AND (w.i - CASE WHEN s.ended THEN w.i ELSE s.first END + 1) * 4 >= 12) OR (w.i - CASE WHEN s.ended THEN w.i ELSE s.first END + 1) * 4 >= 60 FROM s JOIN w ON w.item_id = s.item_id AND w.i = s.i + 1)
  SELECT item_id, beat, min(i) AS first, max(i) AS last, greatest(20, least(60, count(*) * 4)) AS hold FROM s GROUP BY item_id, beat""")
def x38(spark, d):
    """Words of 0.4 seconds each as beats: at the end of a sentence from 1.2 seconds on, at 6 seconds in any case; held for 2 to 6
    seconds (tenths are counted)."""
    words = table(spark, d, "benchmark").select("item_id", F.split("text", r"\s+").alias("w"))
    return words.select("item_id", F.explode(directing.beats(F.col("w"), 4, 12, 60)).alias("b")).select("item_id", "b.beat", "b.first", "b.last", F.greatest(F.lit(20), F.least(F.lit(60), (F.col("b.last") - F.col("b.first") + 1) * 4)).alias("hold"))


@query("x38_capped_beats", r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
  e AS (SELECT doc_id, n, i, least(n, i + 14, coalesce(min(CASE WHEN regexp_matches(x, '[.!?…]$') THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 14 FOLLOWING), n)) AS stop FROM u),
  s AS (SELECT doc_id, n, list(stop ORDER BY i) AS stops, 1::BIGINT AS pos, []::BIGINT[] AS firsts FROM e GROUP BY doc_id, n UNION ALL SELECT doc_id, n, stops, stops[pos] + 1, list_append(firsts, pos) FROM s WHERE pos <= n),
  m AS (SELECT doc_id, n, firsts FROM s WHERE pos > n UNION ALL SELECT doc_id, n, list_concat(firsts[1:k], firsts[k + 2:len(firsts)]) FROM
    (SELECT *, list_position(d, list_min(d)) AS k FROM (SELECT *, list_transform(range(1, len(firsts)), lambda i: firsts[i + 1] - firsts[i]) AS d FROM m WHERE len(firsts) > 24))),
  b AS (SELECT doc_id, unnest(range(1, len(firsts) + 1)) AS beat, unnest(firsts) AS first, unnest(list_transform(list_append(firsts[2:len(firsts)], n + 1), lambda x: x - 1)) AS last FROM m WHERE len(firsts) <= 24)
  SELECT doc_id, beat, first, last, greatest(20, least(60, 4 * (last - first + 1))) AS hold FROM b""")
def x38_capped(spark, d):
    """Every text's words, of four tenths of a second each, as 24 beats at most of two to six seconds."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    timed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (4 * i).cast("long").alias("start"), (4 * i + 4).cast("long").alias("end")))
    return directing.spoken_beats(table(spark, d, "documents").select("doc_id", timed.alias("words")), "doc_id", "words", 20, 60, 24)


@query("r20_archive_routing", """WITH q AS (SELECT unnest(['ring', 'small', 'econ']) AS q), a AS (SELECT p_partkey, p_name, lower(p_type) AS kind, string_split(p_name, ' ') AS words FROM part),
  s AS (SELECT p_partkey, CAST(sum(CASE WHEN contains(kind, q) OR contains(q, kind) THEN 28 ELSE 0 END + CASE WHEN contains(p_name, q) THEN 22 ELSE 0 END + 16 * len(list_filter(words, lambda w: length(w) >= 3 AND (contains(w, q) OR contains(q, w)))) + CASE WHEN q = 'ring' AND contains(p_name, q) THEN 18 ELSE 0 END) AS BIGINT) AS score FROM a, q GROUP BY p_partkey)
  SELECT p_partkey, score, score >= 8 OR (SELECT max(score) FROM s) < 8 AND score = (SELECT max(score) FROM s) AS route FROM s""")
def r20(spark, d):
    """Points for a tag, the name, each of its words and the anchor; routed from 8 points on, or else to the best."""
    words = F.filter(F.split("p_name", " "), lambda w: F.length(w) >= 3)
    score = N.routing(["ring", "small", "econ"], ["ring"], F.array(F.lower("p_type")), F.col("p_name"), words)
    rows = table(spark, d, "part").select("p_partkey", score.alias("score"))
    best = rows.agg(F.max("score").alias("best"))  # one row
    return rows.crossJoin(F.broadcast(best)).select("p_partkey", "score", ((F.col("score") >= 8) | ((F.col("best") < 8) & (F.col("score") == F.col("best")))).alias("route"))


@query("r21_asset_rules", """WITH a AS (SELECT p_partkey, 12 * CAST(contains(p_name, 'ring') AS INTEGER) - 30 * CAST(contains(p_name, 'bolt') AS INTEGER) AS tag, CASE WHEN p_type = 'ECONOMY' THEN 55 WHEN p_type = 'PROMO' THEN -140 ELSE 0 END AS category, p_size FROM part), b AS (SELECT p_partkey, least(60, tag + category + p_size) AS s, tag FROM a)
  SELECT p_partkey, greatest(-100, CASE WHEN tag > 0 THEN s + 9 ELSE s END) AS score FROM b""")
def r21(spark, d):
    """Rules in their order: tags, category, a cap, a bonus for hits after it, a floor."""
    has = lambda w: F.contains("p_name", F.lit(w)).cast("int")
    tag = 12 * has("ring") - 30 * has("bolt")
    category = F.when(F.col("p_type") == "ECONOMY", 55).when(F.col("p_type") == "PROMO", -140).otherwise(0)
    s = F.least(F.lit(60), tag + category + F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(-100), F.when(tag > 0, s + 9).otherwise(s)).alias("score"))


@query("r22_context_score", """SELECT p_partkey, p_size % 5 AS beat, round(greatest(0, least(100, 0.40 * p_size * 2 + 0.25 * p_retailprice / 20 + 0.15 * (p_partkey % 101) + 0.10 * (p_partkey * 7 % 101) + 0.10 * (p_partkey * 13 % 101) + CASE WHEN p_brand LIKE '%1%' THEN 4 ELSE 0 END - CASE WHEN p_partkey % 6 = 0 THEN 12 ELSE 0 END)), 6) AS score FROM part""")
def r22(spark, d):
    """Five parts of a score with their weights, modifiers, bounds."""
    k = F.col("p_partkey")
    parts = 0.40 * F.col("p_size") * 2 + 0.25 * F.col("p_retailprice") / 20 + 0.15 * (k % 101) + 0.10 * (k * 7 % 101) + 0.10 * (k * 13 % 101)
    score = parts + F.when(F.col("p_brand").contains("1"), 4).otherwise(0) - F.when(k % 6 == 0, 12).otherwise(0)
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("beat"), F.round(N.clamp(score, 0.0, 100.0), 6).alias("score"))


@query("r24_metadata_bonuses", """WITH t AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS sources, max(l_quantity) AS q, round(avg(l_discount), 6) AS dis, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, least(30, least(8, 2 * n) + least(6, 3 * (sources - 1)) + CASE WHEN q >= 40 THEN 5 WHEN q >= 25 THEN 2 ELSE 0 END + CASE WHEN dis > 0.05 THEN 3 ELSE 0 END + CASE WHEN r = 0 THEN 4 ELSE 0 END) AS bonus FROM t""")
def r24(spark, d):
    """Bonuses with caps of their own and one for their sum."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("sources"), F.max("l_quantity").alias("q"), F.round(F.avg("l_discount"), 6).alias("dis"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    cap = lambda most, c: F.least(F.lit(most), c)
    bonus = cap(8, 2 * F.col("n")) + cap(6, 3 * (F.col("sources") - 1)) + F.when(F.col("q") >= 40, 5).when(F.col("q") >= 25, 2).otherwise(0) + F.when(F.col("dis") > 0.05, 3).otherwise(0) + F.when(F.col("r") == 0, 4).otherwise(0)
    return t.select("l_orderkey", cap(30, bonus).alias("bonus"))
