"""Scans, filters, joins, set operations and merges of the survey over the driver's tables, each with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import intervals, merging, ranking, shuffles, vectors
from tessera.operators import terms as term_matches
from tessera.plans.book import book
from tessera.plans.reports import _SPANS, spans
from tessera.sources import folders
from tessera.sources.folders import cut
from tessera.sources.tables import table

QUERIES, ORACLES, query = book()


@query("s01_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(spark, d):
    return table(spark, d, "nation")


@query("s02_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 421 LIMIT 1")
def s02(spark, d):
    """By a unique key; the limit is the feature."""
    return table(spark, d, "orders").where("o_orderkey = 421").limit(1).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s04_resume", """WITH c AS (SELECT o_custkey % 8 AS shard, max(o_orderkey) FILTER (o_orderstatus = 'P' AND o_orderdate < DATE '1999-01-01') AS cursor FROM orders GROUP BY ALL)
  SELECT o_custkey % 8 AS shard, o_orderkey FROM orders JOIN c ON o_custkey % 8 = c.shard WHERE o_orderkey > coalesce(c.cursor, -1)""")
def s04(spark, d):
    """A resumed scan: of each shard only what lies beyond its stored cursor. The cursors are a few rows."""
    rows = table(spark, d, "orders").withColumn("shard", F.col("o_custkey") % 8)
    done = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"))
    cursors = rows.groupBy("shard").agg(F.coalesce(F.max(F.when(done, F.col("o_orderkey"))), F.lit(-1)).alias("cursor"))
    return rows.join(F.broadcast(cursors), "shard").where("o_orderkey > cursor").select("shard", "o_orderkey")


@query("s06_files_by_key", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def s06(spark, d):
    """A folder of JSON files with the key in the path, written and read back."""
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return folders.json_by_key(rows, "event_type", "k long").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("s07_audit_folder", "SELECT value >= 10 AS pass, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def s07(spark, d):
    """Audit lines in a folder of JSON files, counted by verdict."""
    lines = folders.json_lines(table(spark, d, "events").select("event_id", "value", (F.col("value") >= 10).alias("pass")))
    return lines.groupBy("pass").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("s10_upsert", """WITH n AS (SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), t AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_custkey % 3 = 0)
  SELECT coalesce(t.k, n.k) AS c_custkey, coalesce(n.latest, t.c_acctbal) AS c_acctbal FROM t FULL JOIN n ON t.k = n.k""")
def s10(spark, d):
    """Rows are inserted, or overwrite the balance of those there."""
    latest = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", "o_orderkey").alias("latest"))
    target = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_acctbal")
    return merging.upsert(target, latest, "c_custkey", {"c_acctbal": F.coalesce("c.latest", "t.c_acctbal")})


@query("s13_vector_store", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS label, len(embedding) AS size FROM embeddings WHERE vec_id % 7 <> 0")
def s13(spark, d):
    """A batch of vectors is put under its ids (new or old), then a batch of ids is deleted."""
    store = table(spark, d, "embeddings")
    batch = store.where("vec_id % 5 = 0").select("vec_id", "embedding", F.lit(99).alias("label"))
    put = merging.upsert(store, batch, "vec_id", {"embedding": F.coalesce("c.embedding", "t.embedding"), "label": F.coalesce("c.label", "t.label")})
    return merging.delete(put, store.where("vec_id % 7 = 0"), "vec_id").select("vec_id", "label", F.size("embedding").cast("long").alias("size"))


@query("s14_literals", "SELECT p.p_partkey, v.priority FROM part p JOIN (VALUES ('ECONOMY', 3), ('PROMO', 1), ('STANDARD', 2)) v(kind, priority) ON p.p_type = v.kind")
def s14(spark, d):
    kinds = spark.createDataFrame([("ECONOMY", 3), ("PROMO", 1), ("STANDARD", 2)], "p_type string, priority int")
    return table(spark, d, "part").join(F.broadcast(kinds), "p_type").select("p_partkey", "priority")


@query("s15_report_sink", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus")
def s15(spark, d):
    """A report written as JSON lines, and read again with its schema."""
    return folders.json_lines(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")))


@query("f01_all_but_json", "SELECT event_id, ts, user_id, event_type, value FROM events")
def f01(spark, d):
    return table(spark, d, "events").drop("props")


@query("f02_conjunction", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def f02(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("f03_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def f03(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("f04_exclusion", "SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND o_orderkey <> 421")
def f04(spark, d):
    return table(spark, d, "orders").where("o_custkey = 42 AND o_orderkey <> 421").select("o_orderkey")


def _ask(text: str):
    """The predicate of a search text: ``#VID-n`` asks for an order, ``#n`` for an order or a customer, others for a part of either column."""
    if text.startswith("#VID-") and text[5:].isdigit():
        return F.col("o_orderkey") == int(text[5:])
    if text.startswith("#") and text[1:].isdigit():
        return (F.col("o_orderkey") == int(text[1:])) | (F.col("o_custkey") == int(text[1:]))
    return F.col("o_orderpriority").ilike(f"%{text}%") | F.col("c_name").ilike(f"%{text}%")


@query("f06_search_text", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, c_name FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT '#VID-7' AS asked, o_orderkey FROM o WHERE o_orderkey = 7 UNION ALL SELECT '#42', o_orderkey FROM o WHERE o_orderkey = 42 OR o_custkey = 42
  UNION ALL SELECT 'urgent', o_orderkey FROM o WHERE o_orderpriority ILIKE '%urgent%' OR c_name ILIKE '%urgent%'""")
def f06(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return reduce(lambda a, b: a.unionByName(b), [rows.where(_ask(text)).select(F.lit(text).alias("asked"), "o_orderkey") for text in ("#VID-7", "#42", "urgent")])


@query("f08_in_json_array", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%'")
def f08(spark, d):
    """A substring of any string of a JSON array."""
    tags = F.to_json(F.array("p_name", "p_type"))
    return table(spark, d, "part").withColumn("tags", tags).where(F.exists(F.from_json("tags", "array<string>"), lambda t: t.ilike("%ring%"))).select("p_partkey")


@query("f09_tag_and_title", "SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%eco%' AND (lower(p_name) LIKE '%small%' OR lower(p_type) LIKE '%small%' OR lower(p_brand) LIKE '%small%')")
def f09(spark, d):
    """A tag that holds the one text, and a title or tag that holds the other."""
    tags = F.array("p_type", "p_brand")
    holds = lambda text: lambda x: F.instr(F.lower(x), text) > 0
    return table(spark, d, "part").where(F.exists(tags, holds("eco")) & (holds("small")(F.col("p_name")) | F.exists(tags, holds("small")))).select("p_partkey")


@query("f10_null_or_below", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality < 1")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").where("quality IS NULL OR quality < 1").select("doc_id")


@query("f11_ttl", "SELECT event_id FROM events WHERE ts + INTERVAL 6 HOUR > (SELECT max(ts) FROM events)")
def f11(spark, d):
    """What hasn't expired at a given time, here that of the last event."""
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    return events.crossJoin(F.broadcast(now)).where("ts + INTERVAL 6 HOURS > now").select("event_id")


@query("f12_version_gate", "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 3 THEN value END AS cached FROM events")
def f12(spark, d):
    """A cached value of another version is a miss (null)."""
    version = F.from_json("props", "k long")["k"] % 4
    return table(spark, d, "events").select("event_id", F.when(version == 3, F.col("value")).alias("cached"))


@query("f17_off_topic", """SELECT p_partkey, (p_name LIKE '%red%' OR p_name LIKE '%blue%') AND NOT (p_type = 'PROMO') OR regexp_matches(p_brand, '#2[0-9]') AS off_topic FROM part""")
def f17(spark, d):
    """Off topic: a modern word outside modern contexts, or a brand of a list."""
    modern = F.exists(F.array(F.lit("red"), F.lit("blue")), lambda w: F.instr("p_name", w) > 0)
    return table(spark, d, "part").select("p_partkey", ((modern & (F.col("p_type") != "PROMO")) | F.col("p_brand").rlike("#2[0-9]")).alias("off_topic"))


@query("f18_semantic_minimum", "SELECT p_partkey FROM part WHERE p_size * 2 >= CASE WHEN p_type = 'ECONOMY' THEN 52 ELSE 38 END")
def f18(spark, d):
    """A score that meets the least of its domain."""
    return table(spark, d, "part").where(F.col("p_size") * 2 >= F.when(F.col("p_type") == "ECONOMY", 52).otherwise(38)).select("p_partkey")


@query("f20_evidence_vote", """WITH f AS (SELECT user_id, date_trunc('hour', ts) AS frame, count(*) AS probes, count(*) FILTER (value > 12) AS hits FROM events GROUP BY ALL),
  v AS (SELECT user_id, count(*) AS frames, count(*) FILTER (hits >= greatest(1, ceil(probes / 2.0))) AS flagged FROM f GROUP BY user_id)
  SELECT user_id, frames, flagged, flagged >= greatest(1, ceil(frames * 0.5)) AND frames >= 2 AS mismatch FROM v""")
def f20(spark, d):
    """Probes vote for a frame (an hour), frames for a user; what is needed follows the size of the group."""
    frames = table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("frame")).agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("value") > 12).alias("hits"))
    flagged = F.count_if(F.col("hits") >= F.greatest(F.lit(1), F.ceil(F.col("probes") / 2)))
    votes = frames.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), flagged.alias("flagged"))
    return votes.withColumn("mismatch", (F.col("flagged") >= F.greatest(F.lit(1), F.ceil(F.col("frames") * 0.5))) & (F.col("frames") >= 2))


@query("j03_not_in_set", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j03(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


PLACES = [("ring", 1), ("small ring", 2), ("bolt", 3), ("red", 4), ("gear", 5)]


@query("j08_fallback_lookup", """WITH v(place, code) AS (VALUES ('ring', 1), ('small ring', 2), ('bolt', 3), ('red', 4), ('gear', 5)), p AS (SELECT DISTINCT p_name FROM part),
  m AS (SELECT p_name, code, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_name = place THEN 0 ELSE 1 END, code) AS k FROM p JOIN v ON p_name = place OR contains(p_name, place) OR contains(place, p_name))
  SELECT p.p_name, m.code FROM p LEFT JOIN m ON p.p_name = m.p_name AND m.k = 1""")
def j08(spark, d):
    """The exact entry, else the first that holds the name or is held by it. The list is a literal."""
    name, entries = F.col("p_name"), F.array(*(F.struct(F.lit(p).alias("place"), F.lit(c).alias("code")) for p, c in PLACES))
    exact = F.filter(entries, lambda e: e["place"] == name)
    near = F.filter(entries, lambda e: F.contains(name, e["place"]) | F.contains(e["place"], name))
    return table(spark, d, "part").select("p_name").distinct().select("p_name", F.try_element_at(F.concat(exact, near), F.lit(1))["code"].alias("code"))


@query("j09_tag_overlap", """WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part), w(tag) AS (VALUES ('small'), ('ringed'), ('re'), ('bolt'))
  SELECT p_partkey, count(DISTINCT t.tag) AS hits FROM t JOIN w ON t.tag = w.tag OR contains(t.tag, w.tag) OR contains(w.tag, t.tag) GROUP BY p_partkey""")
def j09(spark, d):
    """Tags that equal a wanted one, hold it or are held by it, counted where they lie: the wanted ones are a literal."""
    wanted = F.array(*map(F.lit, ("small", "ringed", "re", "bolt")))
    hit = lambda t: F.exists(wanted, lambda w: F.contains(t, w) | F.contains(w, t))
    rows = table(spark, d, "part").select("p_partkey", F.size(F.filter(F.array_distinct(F.split("p_name", " ")), hit)).cast("long").alias("hits"))
    return rows.where("hits > 0")


@query("j13_overlap_ratio", f"""WITH s AS ({_SPANS}) SELECT a.o_custkey, a.id AS left_id, b.id AS right_id, round((least(a."end", b."end") - greatest(a.start, b.start)) / least(a."end" - a.start, b."end" - b.start), 6) AS ratio
  FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.id < b.id AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.65 * least(a."end" - a.start, b."end" - b.start)""")
def j13(spark, d):
    """Spans of one source that share 0.65 of the shorter one (a tighter ratio is a filter on it)."""
    s = spans(spark, d)
    pairs = intervals.overlaps(s, s, "o_custkey", 30.0).where("left_id < right_id")
    size = s.select("id", (F.col("end") - F.col("start")).alias("size"))
    for side in ("left", "right"):
        pairs = pairs.join(size.select(F.col("id").alias(f"{side}_id"), F.col("size").alias(f"{side}_size")), f"{side}_id")
    ratio = F.col("overlap") / F.least("left_size", "right_size")
    return pairs.where(F.col("overlap") >= 0.65 * F.least("left_size", "right_size")).select("o_custkey", "left_id", "right_id", F.round(ratio, 6).alias("ratio"))


@query("j14_adjacent", f"""WITH s AS ({_SPANS}) SELECT a.o_custkey, a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.id < b.id
  AND least(abs(b.start - a."end"), abs(a.start - b."end"), abs(b.start - a.start)) <= 2.5""")
def j14(spark, d):
    """Spans of one source whose ends or beginnings lie 2.5 or less apart; endpoints meet in bins of that width."""
    return intervals.adjacent(spans(spark, d), "o_custkey", 2.5)


@query("j15_zip", "SELECT p_partkey, i - 1 AS place, string_split(p_name, ' ')[i] AS word, string_split(p_type, ' ')[i] AS kind FROM (SELECT *, unnest(range(1, greatest(len(string_split(p_name, ' ')), len(string_split(p_type, ' '))) + 1)) AS i FROM part)")
def j15(spark, d):
    """Parallel arrays by position."""
    zipped = F.arrays_zip(F.split("p_name", " ").alias("word"), F.split("p_type", " ").alias("kind"))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(zipped).alias("place", "z"))
    return rows.select("p_partkey", F.col("place").cast("long").alias("place"), "z.word", "z.kind")


@query("j19_entities", "SELECT doc_id, list_filter(['the ', ' la ', 'password', 'http'], lambda t: contains(lower(text), t)) AS matched FROM documents WHERE text IS NOT NULL AND len(list_filter(['the ', ' la ', 'password', 'http'], lambda t: contains(lower(text), t))) > 0")
def j19(spark, d):
    """The terms that a text holds."""
    matched = F.filter(F.array(*map(F.lit, ("the ", " la ", "password", "http"))), lambda t: F.contains(F.lower("text"), t))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", matched.alias("matched")).where(F.size("matched") > 0)


_TERMS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{7,}')) AS term FROM benchmark"


@query("j19_terms_in_texts", f"WITH t AS ({_TERMS}) SELECT doc_id, count(term) AS n, min(term) AS first FROM documents LEFT JOIN t ON contains(text, term) GROUP BY doc_id")
def j19_terms(spark, d):
    """How many terms of one table (long words of the benchmark) each text holds, anywhere in it, and the first of them."""
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0))).alias("term"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    keyed = lambda c: F.sha2(c, 256)
    hits = term_matches.found(docs, "text", terms, "term", cut).groupBy(keyed(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first"))
    rows = docs.select("doc_id", keyed(F.col("text")).alias("key")).join(hits, "key", "left")
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), "first")


@query("j09_tags_of_two_tables", """WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(html), '[a-z]{3,}')) AS tag FROM pages), r AS (SELECT DISTINCT p_brand, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{3,}')) AS tag FROM part),
  p AS (SELECT a.tag AS x, b.tag AS y FROM (SELECT DISTINCT tag FROM l) a JOIN (SELECT DISTINCT tag FROM r) b ON contains(a.tag, b.tag) OR contains(b.tag, a.tag))
  SELECT page_id, p_brand, count(*) AS pairs FROM l JOIN p ON l.tag = x JOIN r ON r.tag = y GROUP BY ALL""")
def j09_tags(spark, d):
    """Pages and brands by the pairs of their tags of which one is, or is in, the other: both sides are tables."""
    tags = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))).alias("tag")
    left = cut(table(spark, d, "pages").select("page_id", tags(F.col("html"))))
    right = cut(table(spark, d, "part").select("p_brand", tags(F.concat_ws(" ", "p_name", "p_type"))).distinct())
    both = term_matches.overlapping(left, right, "tag", cut)
    joined = left.join(both, left["tag"] == both["left_tag"]).drop("tag").join(right, F.col("right_tag") == F.col("tag"))
    return joined.groupBy("page_id", "p_brand").agg(F.count(F.lit(1)).alias("pairs"))


@query("j20_two_paths", """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ra FROM orders), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rb FROM orders)
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, ra, rb, least(coalesce(ra, 99), coalesce(rb, 99)) AS best FROM (SELECT * FROM a WHERE ra <= 3) a FULL JOIN (SELECT * FROM b WHERE rb <= 3) b ON a.o_orderkey = b.o_orderkey""")
def j20(spark, d):
    """Two retrieval paths meet on their key; the better rank counts."""
    orders = table(spark, d, "orders")
    path = lambda by, name: ranking.top(orders, "o_custkey", [F.desc(by), F.col("o_orderkey")], 3, name).select("o_orderkey", name)
    both = path("o_totalprice", "ra").join(path("o_orderdate", "rb"), "o_orderkey", "full")
    return both.withColumn("best", F.least(F.coalesce("ra", F.lit(99)), F.coalesce("rb", F.lit(99))).cast("long"))


_COS = "SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.e, b.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0"


@query("j21_near_probe", f"WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS ({_COS}) SELECT query_id, min(vec_id) FILTER (s >= 0.97) AS twin, count(*) FILTER (s >= 0.6) AS near FROM p GROUP BY query_id")
def j21(spark, d):
    """For every hundredth vector (the stated query set) the smallest other id from 0.97 on, and how many are near."""
    rows = table(spark, d, "embeddings")
    found = vectors.probed(rows, rows.where("vec_id % 100 = 0"), [0.97, 0.6])
    return found.select(F.col("id").alias("query_id"), F.col("least_0").alias("twin"), F.col("near_1").alias("near"))


_ALL = "WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {}) SELECT u.vec_id, min(other) AS twin, count(other) AS near FROM u LEFT JOIN p USING (vec_id) GROUP BY u.vec_id"


@query("j21_all_twins", _ALL.format(0.97))
def j21_all(spark, d):
    """For every vector the smallest other id from 0.97 on, and how many there are: all rows against all, in blocks."""
    return vectors.twins(table(spark, d, "embeddings").select("vec_id", "embedding"), cut, 0.97)


@query("a36_all_uniqueness", f"SELECT vec_id, greatest(0, least(100, 100 - 15 * near)) AS uniqueness FROM ({_ALL.format(0.85)})")
def a36_all(spark, d):
    """100 less 15 for each vector from 0.85 on, for every vector."""
    rows = vectors.twins(table(spark, d, "embeddings").select("vec_id", "embedding"), cut, 0.85)
    return rows.select("vec_id", F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * F.col("near"))).alias("uniqueness"))


@query("o01_page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def o01(spark, d):
    """A page by two keys, with the number of all matches; offset and limit are the feature."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@query("o02_two_counters", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS wins, count(*) AS uses FROM events GROUP BY user_id ORDER BY wins DESC, uses DESC, user_id LIMIT 15")
def o02(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("wins"), F.count(F.lit(1)).alias("uses"))
    return by.orderBy(F.desc("wins"), F.desc("uses"), "user_id").limit(15)


@query("o03_seeded_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 7919 + 104729) % 65537, o_orderkey) AS place FROM orders")
def o03(spark, d):
    """A shuffle that a seed fixes: by a linear congruence of the key."""
    by = Window.partitionBy("o_custkey").orderBy((F.col("o_orderkey") * 7919 + 104729) % 65537, "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).cast("long").alias("place"))


def _rounds(seed: int) -> str:
    """One walk of ``w`` (id, n, base, x) through the rounds, in SQL."""
    sql = "SELECT id, n, base, step, x // base AS high, x % base AS low FROM w WHERE step = 0 OR x >= n"
    for k in shuffles.round_keys(seed):
        v = f"((low + {k}) % {shuffles.PRIME} * 48271 % {shuffles.PRIME})"
        sql = f"SELECT id, n, base, step, low AS high, (high + xor({v}, {v} >> 15) * 69621 % {shuffles.PRIME}) % base AS low FROM ({sql})"
    return f"SELECT id, n, base, step + 1, high * base + low FROM ({sql})"


@query("o03_shuffled_queue", f"""WITH RECURSIVE r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS x, count(*) OVER () AS n FROM orders),
  w AS (SELECT id, n, CAST(ceil(sqrt(n)) AS BIGINT) AS base, 0 AS step, x FROM r UNION ALL {_rounds(2024)}) SELECT id AS o_orderkey, x + 1 AS place FROM w WHERE step > 0 AND x < n""")
def o03_shuffled(spark, d):
    """All orders in one order that a seed fixes. Only days are counted together; no task sorts the orders."""
    return shuffles.shuffled(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [], "o_orderdate", ["o_orderdate", "o_orderkey"], 2024).select("o_orderkey", "place")


@query("o03_rotated_lists", """WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS x, count(*) OVER (PARTITION BY o_orderpriority) AS n,
    list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(o_orderpriority, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: xor(h, u) * 16777619 % 4294967296) AS seed FROM orders)
  SELECT o_orderpriority, o_orderkey, (x - (seed + 3 * 7919 + (seed >> 13)) % n + n) % n + 1 AS place FROM r""")
def o03_rotated(spark, d):
    """Each priority's orders by day, from a place on that its name's hash gives, for the fourth beat. Five lists hold all rows."""
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    out = shuffles.rotated(rows, ["o_orderpriority"], "o_orderdate", ["o_orderdate", "o_orderkey"], shuffles.name_seed(F.col("o_orderpriority")), F.lit(3))
    return out.select("o_orderpriority", "o_orderkey", "place")


@query("o04_concat", "SELECT 'order' AS origin, o_custkey AS id FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'event', user_id FROM events WHERE value > 20 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_acctbal < 0")
def o04(spark, d):
    parts = [("order", "orders", "o_custkey", "o_totalprice > 200000"), ("event", "events", "user_id", "value > 20"), ("customer", "customer", "c_custkey", "c_acctbal < 0")]
    return reduce(lambda a, b: a.unionByName(b), [table(spark, d, t).where(w).select(F.lit(o).alias("origin"), F.col(k).alias("id")) for o, t, k, w in parts])


@query("o05_difference", "SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'refund'")
def o05(spark, d):
    events = table(spark, d, "events")
    return events.where("event_type = 'view'").select("user_id").subtract(events.where("event_type = 'refund'").select("user_id"))


@query("o06_excluded_of_last", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
  SELECT DISTINCT o_custkey, l_partkey FROM r JOIN lineitem ON o_orderkey = l_orderkey WHERE k <= 2""")
def o06(spark, d):
    """The parts of each customer's last two orders."""
    last = ranking.top(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    return last.join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").select("o_custkey", "l_partkey").distinct()


@query("o07_truncate", "SELECT user_id, list_slice(list(event_id ORDER BY event_id), 1, 4) AS first_ids FROM events GROUP BY user_id")
def o07(spark, d):
    """Lists cut at four; only the rows that stay are gathered."""
    first = ranking.top(table(spark, d, "events"), "user_id", [F.col("event_id")], 4)
    return first.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("first_ids"))


@query("o08_round_dedup", """WITH q AS (SELECT conv_id, turn, role, lower(string_split(text, ' ')[1]) AS w FROM conversations WHERE text IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, w ORDER BY turn) AS k FROM q)
  SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id ORDER BY length(w) DESC, turn) AS place FROM f WHERE k = 1""")
def o08(spark, d):
    """Of queries equal but for case the first of a round stays; they are ordered by confidence."""
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.lower(F.split("text", " ")[0]).alias("w"))
    first = rows.groupBy("conv_id", "w").agg(F.min("turn").alias("turn"))
    by = Window.partitionBy("conv_id").orderBy(F.desc(F.length("w")), "turn")
    return first.select("conv_id", "turn", "w", F.row_number().over(by).cast("long").alias("place"))


@query("m05_claim", """WITH c AS (SELECT o_orderkey AS k, arg_min(w, (a, w)) AS worker FROM (SELECT l_orderkey AS o_orderkey, l_suppkey AS w, l_linenumber AS a FROM lineitem WHERE l_quantity >= 40) GROUP BY ALL)
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND c.worker IS NOT NULL THEN 'T' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN c.worker END AS worker, CAST(CASE WHEN o_orderstatus = 'O' AND c.worker IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempt FROM orders LEFT JOIN c ON o_orderkey = c.k""")
def m05(spark, d):
    """Open orders are taken by their earliest claim; claims on others are lost."""
    claims = table(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("worker"), F.col("l_linenumber").alias("at"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("attempt"))
    return merging.claim(rows, claims, "o_orderkey", "o_orderstatus", "O", "T")


@query("m07_cascade", """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)
  SELECT 'order' AS relation, o_orderkey AS id, o_custkey AS parent FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
  UNION ALL SELECT 'line', l_partkey, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM gone) THEN NULL ELSE l_orderkey END FROM lineitem WHERE l_returnflag = 'R'""")
def m07(spark, d):
    """Rows are deleted and the keys of their children become null."""
    orders = table(spark, d, "orders")
    gone = orders.where("o_custkey % 10 = 3").select("o_orderkey")
    left = merging.delete(orders, gone, "o_orderkey").select(F.lit("order").alias("relation"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"))
    lines = merging.null_out(table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey"), gone.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return left.unionByName(lines.select(F.lit("line").alias("relation"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("parent")))


@query("m08_purge", "SELECT event_id FROM events WHERE NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-01 12:00:00')")
def m08(spark, d):
    """What has expired goes."""
    return table(spark, d, "events").where(~((F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-01 12:00:00").cast("timestamp")))).select("event_id")


@query("m10_audit_append", """SELECT o_orderkey, 1 AS version, o_orderstatus AS state FROM orders WHERE o_custkey % 20 = 0 UNION ALL SELECT o_orderkey, 2, 'X' FROM orders WHERE o_custkey % 20 = 0 AND o_orderstatus = 'F'""")
def m10(spark, d):
    """An append-only log: snapshots, then one line for each change; nothing written is changed."""
    snapshot = table(spark, d, "orders").where("o_custkey % 20 = 0").select("o_orderkey", F.lit(1).alias("version"), F.col("o_orderstatus").alias("state"))
    change = snapshot.where("state = 'F'").select("o_orderkey", F.lit(2).alias("version"), F.lit("X").alias("state"))
    return folders.appended([snapshot, change])
