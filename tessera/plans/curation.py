"""Deduplication and range repair of the survey over the driver's tables, each with its oracle.

Ranges are the gaps between a user's events in tenths of an hour, as whole numbers, so that both engines compute the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.operators import greedy, hamming, ranking, sequences, timelines
from tessera.plans.book import book
from tessera.sources.folders import cut
from tessera.sources.tables import table

QUERIES, ORACLES, query = book()


def n_rows() -> Column:
    return F.count(F.lit(1))


@query("d02_two_keys", """WITH RECURSIVE c AS (SELECT l_orderkey AS k, l_linenumber * 100000 + l_partkey AS o, l_suppkey % 3 AS a, l_partkey % 4 AS b FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, a, b) AS i FROM c),
  s AS (SELECT k, o, a, b, i, [a] AS xs, [b] AS ys, true AS kept FROM r WHERE i = 1 UNION ALL SELECT r.k, r.o, r.a, r.b, r.i, CASE WHEN list_contains(xs, r.a) OR list_contains(ys, r.b) THEN xs ELSE list_append(xs, r.a) END, CASE WHEN list_contains(xs, r.a) OR list_contains(ys, r.b) THEN ys ELSE list_append(ys, r.b) END, NOT (list_contains(xs, r.a) OR list_contains(ys, r.b)) FROM s JOIN r ON r.k = s.k AND r.i = s.i + 1)
  SELECT k AS l_orderkey, o AS place, a AS id, b AS url FROM s WHERE kept""")
def d02(spark, d):
    """A candidate goes if its id or its address was kept before; those that go register neither."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("place"), (F.col("l_suppkey") % 3).alias("id"), (F.col("l_partkey") % 4).alias("url"))
    return greedy.first_of_two_keys(rows, "l_orderkey", "place", "id", "url")


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a 24-bit picture hash, close in groups of six keys."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), ((F.floor(key / 6) * 2654435761 % 16777216).bitwiseXOR(F.element_at(F.array(*map(F.lit, (0, 1, 3, 7, 15, 31))), (key % 6 + 1).cast("int")))).alias("hash"))


def wide(key: Column) -> Column:
    """A picture hash of 64 bits, close in groups of six keys."""
    return (F.floor(key / 6) % 1000003 * 2654435761 * 97).bitwiseXOR(F.element_at(F.array(*map(F.lit, (0, 1, 7, 127, 2047, 65535))), (key % 6 + 1).cast("int")))


_HASH = "SELECT c_custkey AS id, xor((c_custkey // 6) * 2654435761 % 16777216, [0, 1, 3, 7, 15, 31][c_custkey % 6 + 1]) AS hash FROM customer"


_PICTURES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 77 = 5 THEN 0 ELSE xor((c_custkey // 6) % 1000003 * 2654435761 * 97, [0, 1, 7, 127, 2047, 65535][c_custkey % 6 + 1]) END AS hash FROM customer"


@query("d03_keep_oldest", f"""WITH RECURSIVE h AS ({_PICTURES}), r AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM h WHERE hash IS NOT NULL), s AS (SELECT id, i, [hash] AS got, true AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.id, r.i, CASE WHEN len(list_filter(got, lambda x: x = r.hash OR (x <> 0 AND r.hash <> 0 AND bit_count(xor(x, r.hash)) <= 8))) > 0 THEN got ELSE list_append(got, r.hash) END, len(list_filter(got, lambda x: x = r.hash OR (x <> 0 AND r.hash <> 0 AND bit_count(xor(x, r.hash)) <= 8))) = 0 FROM s JOIN r ON r.i = s.i + 1)
  SELECT id, kept FROM s UNION ALL SELECT id, true FROM h WHERE hash IS NULL""")
def d03(spark, d):
    """In order of id, a picture goes if a kept one is within 8 of 64 bits; near one that went is no reason. A hash of 0 (one colour)
    is near its equals only; a picture without a hash stays."""
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(key.alias("id"), F.when(key % 50 == 3, F.lit(None)).when(key % 77 == 5, F.lit(0)).otherwise(wide(key)).alias("hash"))
    near = cut(hamming.pairs(rows.where("hash <> 0"), "hash", 8, 64, cut).select("left_hash", "right_hash"))  # cut, so that its true size is known to the joins
    firsts = cut(rows.where("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("first")))  # of equal hashes the oldest stands for all
    by = lambda side: firsts.select(F.col("hash").alias(f"{side}_hash"), F.col("first").alias(f"{side}_id"))
    pairs = near.join(by("left"), "left_hash").join(by("right"), "right_hash").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    kept = greedy.keep_first_of_near(firsts.select(F.col("first").alias("id")), cut(pairs), cut).where("kept").select("id", F.lit(True).alias("kept"))
    return rows.join(kept, "id", "left").select("id", F.coalesce("kept", F.col("hash").isNull()).alias("kept"))


@query("d04_frames", f"""WITH h AS ({_HASH}), f AS (SELECT id // 3 AS clip, hash FROM h), p AS (SELECT a.clip AS a, b.clip AS b, a.hash AS x, min(bit_count(xor(a.hash, b.hash))) AS least FROM f a JOIN f b ON b.clip = a.clip + 1 GROUP BY ALL),
  n AS (SELECT clip, count(*) AS n FROM f GROUP BY clip) SELECT p.a AS clip, count(*) FILTER (least <= 2) AS matches, count(*) FILTER (least <= 2) >= greatest(1, ceil(least(any_value(m.n), any_value(o.n)) * 2 / 3)) AS same FROM p JOIN n m ON p.a = m.clip JOIN n o ON p.b = o.clip GROUP BY p.a""")
def d04(spark, d):
    """Clips of several frames match where two thirds of the frames have a near one in the next clip."""
    clips = hashes(spark, d).groupBy(F.floor(F.col("id") / 3).alias("clip")).agg(F.collect_set("hash").alias("frames"), n_rows().alias("n"))
    both = clips.join(clips.select((F.col("clip") - 1).alias("clip"), F.col("frames").alias("others"), F.col("n").alias("m")), "clip")
    near = F.size(F.filter("frames", lambda x: F.exists("others", lambda y: F.bit_count(x.bitwiseXOR(y)) <= 2))).cast("long")
    return both.select("clip", near.alias("matches"), (near >= F.greatest(F.lit(1), F.ceil(F.least("n", "m") * 2 / 3))).alias("same"))


@query("d05_batch_and_index", """WITH t AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 24) AS key FROM documents), i AS (SELECT DISTINCT key FROM t WHERE doc_id % 2 = 0), b AS (SELECT key, min(doc_id) AS doc_id FROM t WHERE doc_id % 2 = 1 GROUP BY key)
  SELECT doc_id, key FROM b WHERE key NOT IN (SELECT key FROM i)""")
def d05(spark, d):
    """Of a batch, the first of each content that the index doesn't have."""
    rows = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 24).alias("key"))
    batch = rows.where("doc_id % 2 = 1").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return batch.join(rows.where("doc_id % 2 = 0").select("key"), "key", "left_anti").select("doc_id", "key")


@query("d06_ordered_distinct", "SELECT conv_id, list(w ORDER BY i) AS words FROM (SELECT conv_id, lower(trim(role)) AS w, min(turn) AS i FROM conversations WHERE trim(role) <> '' GROUP BY conv_id, lower(trim(role))) GROUP BY conv_id")
def d06(spark, d):
    """Distinct but for case and blanks, in the order first seen."""
    first = table(spark, d, "conversations").where("trim(role) <> ''").groupBy("conv_id", F.lower(F.trim("role")).alias("w")).agg(F.min("turn").alias("i"))
    return first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))


@query("d07_merged_lists", """WITH l AS (SELECT p_size % 5 AS beat, p_partkey % 400 AS q, p_partkey % 3 AS list, p_retailprice AS s, p_partkey AS o FROM part), f AS (SELECT beat, q, arg_min(s, (list, o)) AS s FROM l GROUP BY beat, q), r AS (SELECT *, row_number() OVER (PARTITION BY beat ORDER BY s DESC, q) AS place FROM f)
  SELECT beat, q, s, place FROM r WHERE place <= 30""")
def d07(spark, d):
    """Ranked lists merged: the first occurrence counts; by score, thirty at most, ranked anew."""
    rows = table(spark, d, "part").select((F.col("p_size") % 5).alias("beat"), (F.col("p_partkey") % 400).alias("q"), F.struct((F.col("p_partkey") % 3).alias("list"), "p_partkey").alias("o"), F.col("p_retailprice").alias("s"))
    return ranking.top(rows.groupBy("beat", "q").agg(F.min_by("s", "o").alias("s")), "beat", [F.desc("s"), F.col("q")], 30)


@query("d08_fragment_prepass", f"""WITH RECURSIVE f AS (SELECT l_suppkey % 40 AS src, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS id, l_partkey % 500 AS a, l_partkey % 500 + 6 AS b FROM lineitem), u AS (SELECT src, min(id) AS id, a, b FROM f GROUP BY src, a, b), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY id) AS i FROM u),
  s AS (SELECT src, id, i, [a] AS got, true AS kept FROM r WHERE i = 1 UNION ALL SELECT r.src, r.id, r.i, CASE WHEN len(list_filter(got, lambda x: abs(x - r.a) <= 2)) > 0 THEN got ELSE list_append(got, r.a) END, len(list_filter(got, lambda x: abs(x - r.a) <= 2)) = 0 FROM s JOIN r ON r.src = s.src AND r.i = s.i + 1)
  SELECT src, id, kept FROM s""")
def d08(spark, d):
    """Before any content is looked at: in order of id, a fragment goes if a kept one of its source covers most of it."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("src"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("id"), (F.col("l_partkey") % 500).alias("a"))
    first = cut(rows.groupBy("src", "a").agg(F.min("id").alias("id")))  # equal fragments: the oldest stands for all
    near = first.select("src", F.col("id").alias("i"), F.explode(F.sequence(F.col("a") - 2, F.col("a") + 2)).alias("a")).join(first, ["src", "a"]).where("i < id").select(F.col("i").alias("left_id"), F.col("id").alias("right_id"), "src")
    nodes = first.select(F.struct("src", "id").alias("id"))
    pair = near.select(F.struct("src", F.col("left_id").alias("id")).alias("left_id"), F.struct("src", F.col("right_id").alias("id")).alias("right_id"))
    return greedy.keep_first_of_near(nodes, pair, cut).select("id.src", "id.id", "kept")


def cuts(spark: SparkSession, d: str) -> DataFrame:
    """user_id and the ascending distinct times of the user's events, in tenths of an hour as doubles."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 360_000_000) - 4733424  # from the first day on
    return table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_set(t)), lambda x: x.cast("double")).alias("cuts"))


def moments(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """user_id, t (as in ``cuts``), day and ``more`` of each event, distinct."""
    t = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 360_000_000) - 4733424).cast("double")
    rows = table(spark, d, "events").select("user_id", t.alias("t"), *more).distinct()
    return rows.withColumn("day", F.floor(F.col("t") / 240))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    return timelines.ranges_between(moments(spark, d), "user_id", "day", "t")


_CUTS = "c AS (SELECT user_id, list_sort(list_distinct(list(floor(epoch_us(ts) / 360000000)::DOUBLE - 4733424))) AS cuts FROM events GROUP BY user_id)"
_RANGES = f"{_CUTS}, g AS (SELECT user_id, list_transform(range(1, len(cuts)), lambda i: {{'start': cuts[i], 'end': cuts[i + 1]}}) AS r FROM c WHERE len(cuts) > 1)"


def exploded(rows: DataFrame, name: str = "r") -> DataFrame:
    return rows.select("user_id", F.explode(name).alias("x")).select("user_id", "x.start", "x.end")


@query("d11_least_duration", f"""WITH RECURSIVE {_RANGES}, s AS (SELECT user_id, r, 0 AS step, list_position(list_transform(r, lambda x: x['end'] - x['start'] < 4), true) AS k FROM g
  UNION ALL SELECT user_id, m, step + 1, list_position(list_transform(m, lambda x: x['end'] - x['start'] < 4), true) FROM (SELECT user_id, step, list_concat(list_concat(r[1:j - 1], [{{'start': r[j]['start'], 'end': r[j + 1]['end']}}]), r[j + 2:]) AS m
    FROM (SELECT *, CASE WHEN k = len(r) OR (k > 1 AND r[k - 1]['end'] - r[k - 1]['start'] <= r[k + 1]['end'] - r[k + 1]['start']) THEN k - 1 ELSE k END AS j FROM s WHERE k > 0 AND len(r) > 1))),
  f AS (SELECT user_id, arg_max(r, step) AS r FROM s GROUP BY user_id) SELECT user_id, x['start'] AS start, x['end'] AS "end" FROM (SELECT user_id, unnest(r) AS x FROM f)""")
def d11(spark, d):
    """Ranges shorter than 4 are merged into their shorter neighbour until none is left."""
    return timelines.long_enough(cut(ranges(spark, d)), "user_id", "day", 4.0)


@query("d12_capped_ranges", f"""WITH RECURSIVE {_RANGES}, b AS (SELECT *, list_sort(list_filter(list_transform(range(1, len(r)), lambda i: [(r[i]['end'] - r[i]['start']) + (r[i + 1]['end'] - r[i + 1]['start']), CAST(i AS DOUBLE), least(r[i]['end'] - r[i]['start'], r[i + 1]['end'] - r[i + 1]['start'])]), lambda p: p[3] <= 2))[1][2]::BIGINT AS j, 0 AS step FROM g),
  s AS (SELECT user_id, r, j, step FROM b UNION ALL SELECT user_id, m, list_sort(list_filter(list_transform(range(1, len(m)), lambda i: [(m[i]['end'] - m[i]['start']) + (m[i + 1]['end'] - m[i + 1]['start']), CAST(i AS DOUBLE), least(m[i]['end'] - m[i]['start'], m[i + 1]['end'] - m[i + 1]['start'])]), lambda p: p[3] <= 2))[1][2]::BIGINT, step + 1
    FROM (SELECT user_id, step, list_concat(list_concat(r[1:j - 1], [{{'start': r[j]['start'], 'end': r[j + 1]['end']}}]), r[j + 2:]) AS m FROM s WHERE len(r) > 60 AND j IS NOT NULL)),
  f AS (SELECT user_id, arg_max(r, step) AS r FROM s GROUP BY user_id), e AS (SELECT user_id, CASE WHEN len(r) > 60 THEN list_transform(range(0, 60), lambda i: r[CAST(floor(i * len(r) / 60) AS BIGINT) + 1]) ELSE r END AS r FROM f) SELECT user_id, x['start'] AS start, x['end'] AS "end" FROM (SELECT user_id, unnest(r) AS x FROM e)""")
def d12(spark, d):
    """At most sixty ranges: flashes are merged first, then an even sample stays."""
    return timelines.capped(cut(ranges(spark, d)), "user_id", "day", 60, 2.0, cut)


@query("d14_interior_points", f"""WITH {_CUTS}, p AS (SELECT user_id, list_concat(list_concat([0.0], list_filter(cuts, lambda t: t > 3 AND t < 97)), [100.0]) AS p FROM c), x AS (SELECT user_id, unnest(list_transform(range(1, len(p)), lambda i: {{'start': p[i], 'end': p[i + 1]}})) AS x FROM p)
  SELECT user_id, x['start'] AS start, x['end'] AS "end" FROM x WHERE x['end'] - x['start'] >= 3""")
def d14(spark, d):
    """D-14 and D-15: the range 0 to 100 split at the points inside, without pieces shorter than 3."""
    return exploded(cuts(spark, d).select("user_id", greedy.split_at(F.lit(0.0), F.lit(100.0), F.col("cuts"), 3.0).alias("r")))


@query("d15_tolerance", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity * 0.1 >= 2 - 0.02")
def d15(spark, d):
    """Ranges that are too short by more than the tolerance go."""
    return table(spark, d, "lineitem").where(F.col("l_quantity") * 0.1 >= 2 - 0.02).select("l_orderkey", "l_linenumber", "l_partkey")


@query("d16_pushed_overlays", f"""WITH RECURSIVE {_CUTS}, o AS (SELECT user_id, unnest(cuts) AS a, unnest(range(1, len(cuts) + 1)) AS i FROM c), s AS (SELECT user_id, 0::BIGINT AS i, -1e9::DOUBLE AS last, NULL::DOUBLE AS start, NULL::DOUBLE AS "end" FROM c
  UNION ALL SELECT o.user_id, o.i, CASE WHEN e <= b + 0.25 THEN s.last ELSE e END, CASE WHEN e <= b + 0.25 THEN NULL ELSE b END, CASE WHEN e <= b + 0.25 THEN NULL ELSE e END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1, LATERAL (SELECT greatest(o.a, s.last + 2) AS b) x, LATERAL (SELECT least(400, x.b + 3) AS e) y)
  SELECT user_id, start, "end" FROM s WHERE start IS NOT NULL""")
def d16(spark, d):
    """Overlays of length 3 with a gap of 2: pushed back where they overlap, up to 400; what has a quarter or less left goes."""
    overlays = moments(spark, d).withColumnRenamed("t", "start")
    return timelines.pushed(overlays, "user_id", "day", ["start"], F.lit(3.0), 2.0, 0.25, 400.0)


@query("d17_spaced_choice", """WITH RECURSIVE c AS (SELECT DISTINCT user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS pri, floor(epoch_us(ts) / 360000000)::DOUBLE - 4733424 AS t FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pri, t) AS i FROM c),
  s AS (SELECT user_id, i, t, pri, [t] AS got, true AS kept FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, r.t, r.pri, CASE WHEN len(got) < 5 AND len(list_filter(got, lambda x: abs(x - r.t) < 12)) = 0 THEN list_append(got, r.t) ELSE got END, len(got) < 5 AND len(list_filter(got, lambda x: abs(x - r.t) < 12)) = 0 FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
  SELECT user_id, pri, t FROM s WHERE kept""")
def d17(spark, d):
    """By priority, then time: five at most, each 12 or more from all taken."""
    pri = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return timelines.spaced(cut(moments(spark, d, pri.alias("pri"))), "user_id", "day", "pri", "t", 12.0, 5)


_WIDE = "SELECT DISTINCT xor((c_custkey // 6) % 1000003 * 2654435761 * 97, [0, 1, 7, 127, 2047, 65535][c_custkey % 6 + 1]) AS hash FROM customer"


@query("j11_near_hashes", f"WITH h AS ({_WIDE}) SELECT a.hash AS left_hash, b.hash AS right_hash, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM h a JOIN h b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 8")
def j11(spark, d):
    """Picture hashes of 64 bits (made up, close in groups of six keys), 8 bits apart at most."""
    return hamming.pairs(table(spark, d, "customer").select(wide(F.col("c_custkey")).alias("hash")), "hash", 8, 64, cut)


@query("w01_global_queue", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'")
def w01(spark, d):
    """The place of an open order in the one queue of all, by time and key; days are counted first, so that no task sorts the queue."""
    return sequences.numbered(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate"), [], "o_orderdate", ["o_orderdate", "o_orderkey"], "position").select("o_orderkey", "position")


@query("a42_repeated_members", "WITH g AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL HAVING count(*) > 1) SELECT o_custkey, o_orderpriority, n, first, o_orderkey FROM g JOIN orders USING (o_custkey, o_orderpriority)")
def a42(spark, d):
    """Keys that occur more than once with their members, a row each; ``first`` gives the order of the groups."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    g = orders.groupBy("o_custkey", "o_orderpriority").agg(n_rows().alias("n"), F.min("o_orderkey").alias("first")).where("n > 1")
    return g.join(orders, ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority", "n", "first", "o_orderkey")


@query("f07_substring_any_case", "SELECT p_partkey FROM part WHERE p_type ILIKE '%econ%' AND p_brand LIKE 'Brand#1%'")
def f07(spark, d):
    """F-07 and F-13: a substring in any case, and a prefix."""
    return table(spark, d, "part").where(F.col("p_type").ilike("%econ%") & F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("f19_silent", "SELECT p_brand, count(*) AS asked FROM part GROUP BY p_brand HAVING count(*) >= 20 AND count(*) FILTER (p_retailprice > 1995 AND p_size = 7) = 0")
def f19(spark, d):
    """Gates asked twenty times or more that never fired."""
    by = table(spark, d, "part").groupBy("p_brand").agg(n_rows().alias("asked"), F.count_if((F.col("p_retailprice") > 1995) & (F.col("p_size") == 7)).alias("fired"))
    return by.where("asked >= 20 AND fired = 0").select("p_brand", "asked")


@query("j02_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000) ORDER BY c_custkey LIMIT 100")
def j02(spark, d):
    """The first hundred without a match; order and limit are the feature."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti").orderBy("c_custkey").limit(100)


@query("m11_spread_slugs", "SELECT p_partkey, CASE WHEN k > 1 THEN slug || '-' || k ELSE slug END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def m11(spark, d):
    """The first row of a slug keeps it, the next ones get -2, -3 and so on; a slug's rows are numbered in stretches of keys."""
    rows = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.floor(F.col("p_partkey") / 1000).alias("stretch"))
    k = sequences.numbered(rows, ["slug"], "stretch", ["p_partkey"], "k")
    return k.select("p_partkey", F.when(F.col("k") > 1, F.concat_ws("-", "slug", "k")).otherwise(F.col("slug")).alias("slug"))
