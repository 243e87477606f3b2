"""Scalar functions and the batch forms of continuous queries of the survey, each with its oracle."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import lifecycle, ranking
from tessera.plans.book import book
from tessera.sources.tables import table

QUERIES, ORACLES, query = book()


def n_rows() -> Column:
    return F.count(F.lit(1))


@query("x01_text_key", rf"SELECT doc_id, substr(trim(regexp_replace(lower(text), '{T.BLANKS}', ' ', 'g'), ' '), 1, 256) AS key FROM documents")
def x01(spark, d):
    """Lower case, trimmed, single blanks, 256 characters, of every text; null stays null."""
    return table(spark, d, "documents").select("doc_id", T.key(F.col("text")).alias("key"))


@query("x02_slug_diacritics", r"SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(strip_accents(lower(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100), ''), 'archive') AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE page_id % 4 WHEN 0 THEN ' őžșĐ ǖẬ' WHEN 1 THEN ' é ŁÓDŹ ñ' ELSE '' END AS t FROM pages)")
def x02(spark, d):
    """Letters lose their diacritics, anything else becomes single hyphens; a default for what leaves nothing."""
    more = F.when(F.col("page_id") % 4 == 0, " őžșĐ ǖẬ").when(F.col("page_id") % 4 == 1, " e\u0301 ŁÓDŹ ñ").otherwise("")
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), more)
    return table(spark, d, "pages").select("page_id", T.plain_slug(title, "archive").alias("slug"))


@query("x03_latin_slug", r"SELECT page_id, regexp_replace(regexp_replace(lower(t), '[^a-z0-9à-öø-ÿ''-]+', ' ', 'g'), '^ +| +$', '', 'g') AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)")
def x03(spark, d):
    """Latin-1 letters, apostrophes and hyphens stay."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(title, "[^a-z0-9à-öø-ÿ'-]+", " "), "^ +| +$", "").alias("slug"))


@query("x04_tokens", """WITH t AS (SELECT item_id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM benchmark)
  SELECT item_id, list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that', 'with')) AS relevant, list_filter(w, lambda x: length(x) > 2) AS longer, list_filter(w, lambda x: length(x) >= 4 OR x IN ('ai', 'eu', 'in')) AS anchors FROM t""")
def x04(spark, d):
    """Three tokenisers: without stop words, by length, and by length with a list of short topics."""
    rows = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), "[^a-z0-9]+").alias("w"))
    keep = lambda test: F.filter("w", test)
    return rows.select(
        "item_id", keep(lambda x: (F.length(x) >= 3) & ~x.isin("the", "and", "that", "with")).alias("relevant"), keep(lambda x: F.length(x) > 2).alias("longer"),
        keep(lambda x: (F.length(x) >= 4) | x.isin("ai", "eu", "in")).alias("anchors"))


@query("x05_keyword_hits", "SELECT doc_id, len(list_filter(list_distinct(list_filter(string_split('and the essen la password of', ' '), lambda k: length(k) >= 3)), lambda k: contains(lower(text), k))) AS hits FROM documents WHERE text IS NOT NULL")
def x05(spark, d):
    """How many keywords of three letters or more a text holds."""
    words = [w for w in "and the essen la password of".split() if len(w) >= 3]
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", N.hits(F.lower("text"), words).cast("long").alias("hits"))


@query("x06_token_recall", "SELECT item_id, round(len(list_filter(['the', 'and', 'of', 'essen'], lambda k: list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), k))) / 4, 6) AS recall FROM benchmark")
def x06(spark, d):
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    expected = F.array(*map(F.lit, ("the", "and", "of", "essen")))
    return table(spark, d, "benchmark").select("item_id", F.round(F.size(F.filter(expected, lambda k: F.array_contains(words, k))) / 4, 6).alias("recall"))


@query("x07_topic_bucket", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'password|secret|token') THEN 'security' WHEN regexp_matches(lower(text), 'https?://') THEN 'web' ELSE array_to_string(list_slice(list_filter(string_split_regex(lower(substr(text, 1, 200)), '[^a-z]+'), lambda w: length(w) >= 5), 1, 4), ' ') END AS topic FROM documents WHERE text IS NOT NULL")
def x07(spark, d):
    """The first pattern that matches, else the first four long words of the head (200 characters are the feature: a topic key)."""
    low = F.lower("text")
    words = F.slice(F.filter(F.split(F.lower(F.substring("text", 1, 200)), "[^a-z]+"), lambda w: F.length(w) >= 5), 1, 4)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.when(low.rlike("password|secret|token"), "security").when(low.rlike("https?://"), "web").otherwise(F.array_join(words, " ")).alias("topic"))


@query("x08_classify", "SELECT page_id, CASE WHEN regexp_matches(url, '/(fr|de|es)/') THEN 'foreign' WHEN regexp_matches(url, 'page=[0-9]') THEN 'paged' WHEN regexp_matches(url, '\\?') THEN 'query' ELSE 'plain' END AS kind FROM pages")
def x08(spark, d):
    """The first of an ordered list of patterns."""
    return table(spark, d, "pages").select("page_id", F.when(F.col("url").rlike("/(fr|de|es)/"), "foreign").when(F.col("url").rlike("page=[0-9]"), "paged").when(F.col("url").rlike(r"\?"), "query").otherwise("plain").alias("kind"))


@query("x09_energy", """WITH h AS (SELECT item_id, len(list_filter(['the', 'ess', 'that'], lambda k: contains(lower(text), k))) AS high, len(list_filter(['blee', 'with', 'ing'], lambda k: contains(lower(text), k))) AS low FROM benchmark)
  SELECT item_id, high, low, CASE WHEN high > low THEN 'high' WHEN low > high THEN 'low' ELSE 'medium' END AS energy, CASE WHEN high > low THEN 3 WHEN low > high THEN 8 ELSE 5 END AS pace FROM h""")
def x09(spark, d):
    """High against low words, the energy that dominates, and its pace."""
    rows = table(spark, d, "benchmark").select("item_id", N.hits(F.lower("text"), ["the", "ess", "that"]).cast("long").alias("high"), N.hits(F.lower("text"), ["blee", "with", "ing"]).cast("long").alias("low"))
    by = lambda *v: F.when(F.col("high") > F.col("low"), v[0]).when(F.col("low") > F.col("high"), v[1]).otherwise(v[2])
    return rows.select("item_id", "high", "low", by("high", "low", "medium").alias("energy"), by(3, 8, 5).alias("pace"))


@query("x10_fragment_note", """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Fragment uit Clip' || l_suppkey || '.mp4 (' || l_partkey % 60 || ':' || lpad(CAST(l_orderkey % 60 AS VARCHAR), 2, '0') || '–' || (l_partkey % 60 + l_linenumber % 2) || ':' || lpad(CAST((l_orderkey + 9) % 60 AS VARCHAR), 2, '0') || ')' AS note FROM lineitem),
  x AS (SELECT *, 60 * (l_partkey % 60) + l_orderkey % 60 AS a, 60 * (l_partkey % 60 + l_linenumber % 2) + (l_orderkey + 9) % 60 AS b, 'clip' || split_part(split_part(note, 'Clip', 2), '.', 1) || '.mp4' AS src FROM n)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b > a THEN src END AS source, CASE WHEN b > a THEN a END AS start, CASE WHEN b > a THEN b END AS "end" FROM x""")
def x10(spark, d):
    """A note such as "Fragment uit a.mp4 (1:05–1:14)" as source and seconds; null where the end isn't after the start."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part, order, line = (F.col(c) for c in ("l_partkey", "l_orderkey", "l_linenumber"))
    note = F.concat(F.lit("Fragment uit Clip"), F.col("l_suppkey"), F.lit(".mp4 ("), part % 60, F.lit(":"), two(order % 60), F.lit("–"), part % 60 + line % 2, F.lit(":"), two((order + 9) % 60), F.lit(")"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.fragment(note).alias("f")).select("l_orderkey", "l_linenumber", "l_partkey", "f.source", "f.start", "f.end")


@query("x11_numbers_in_log", """SELECT user_id, list_filter(list_transform(string_split(string_agg('pts_time:' || value, ' ' ORDER BY event_id), ' '), lambda x: CAST(split_part(x, ':', 2) AS DOUBLE)), lambda t: t > 2 AND t < 18) AS times FROM events GROUP BY user_id""")
def x11(spark, d):
    """The numbers after a mark in a log, those within bounds."""
    logs = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.concat(F.lit("pts_time:"), x["value"])), " ").alias("log"))
    times = F.transform(F.regexp_extract_all("log", F.lit("pts_time:([0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))
    return logs.select("user_id", F.filter(times, lambda t: (t > 2) & (t < 18)).alias("times"))


@query("x12_proper_noun", r"""WITH m AS (SELECT item_id, regexp_extract(text, '[a-z,] ([A-Z][a-z]+ [A-Z][a-z]+)', 1) AS two, regexp_extract(text, '[a-z,] ([A-Z][a-z]{2,})', 1) AS one, list_sort(list_transform(list_distinct(string_split_regex(lower(text), '[^a-z]+')), lambda w: [lpad(CAST(999 - length(w) AS VARCHAR), 3, '0'), w]))[1][2] AS longest FROM benchmark)
  SELECT item_id, CASE WHEN two <> '' THEN two WHEN one <> '' THEN one ELSE longest END AS word FROM m""")
def x12(spark, d):
    """Two capitalised words inside a sentence, else one, else the longest word (the first by the alphabet among equals)."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    longest = F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]
    first = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    return table(spark, d, "benchmark").select("item_id", F.coalesce(first("[a-z,] ([A-Z][a-z]+ [A-Z][a-z]+)"), first("[a-z,] ([A-Z][a-z]{2,})"), longest).alias("word"))


_CALM = r"regexp_replace(regexp_replace(regexp_replace(CASE doc_id % 3 WHEN 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN text ELSE 'LIVE FROM Old Town, on March 15, 1943' || chr(10) || 'BREAKING STORM HITS COAST' || chr(10) || text || ' JOHN SMITH 04/06/1944' END, '\r\n|[\r\x{2028}\x{2029}]', chr(10), 'g'), '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]', ' ', 'g'), '[^\x00-\x7F]', chr(1), 'g')"
_EVERY = lambda pattern: r"list_transform(regexp_extract_all(t, '" + pattern.replace("'", "''") + r"', 1), lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '))"


@query("x13_text_entities", rf"""WITH c AS (SELECT doc_id, {_CALM} AS t FROM documents),
  e AS (SELECT doc_id, list_transform({_EVERY(T.YEARS)} || {_EVERY(T.DATES)} || {_EVERY(T.NUMBER_DATES)}, lambda x: 'date:' || x) AS dates,
    list_transform(list_filter({_EVERY(T.PLACES)}, lambda x: length(x) BETWEEN 3 AND 35), lambda x: 'location:' || x) AS places,
    list_transform(list_filter(list_transform({_EVERY(T.NAMES)}, lambda x: regexp_split_to_array(x, '[\x09-\x0D ]+')), lambda w: NOT list_has_any(w, {T.NO_NAMES}) AND length(w[1]) <= 18 AND length(w[2]) <= 18), lambda w: 'person:' || w[1] || ' ' || w[2]) AS names,
    list_transform(list_filter({_EVERY(T.HEADLINES)}, lambda x: regexp_matches(x, '[A-Z]{{4,}}')), lambda x: 'headline:' || x) AS heads FROM c),
  f AS (SELECT doc_id, dates || places || names || heads AS found FROM e)
  SELECT doc_id, list_filter(found, lambda x, i: list_position(found, x) = i)[1:60] AS entities FROM f""")
def x13(spark, d):
    """Years, dates, places, names and headlines of every text, a third of them in capitals as read off pictures, a third with a ticker's lines."""
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", ascii_lowercase, ascii_uppercase)).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("LIVE FROM Old Town, on March 15, 1943\nBREAKING STORM HITS COAST\n"), "text", F.lit(" JOHN SMITH 04/06/1944")))
    return table(spark, d, "documents").select("doc_id", T.calm(text).alias("calm")).select("doc_id", T.entities(F.col("calm")).alias("entities"))


@query("x14_provider", "SELECT page_id, CASE WHEN split_part(k, ':', 1) IN ('http', 'unknown') THEN NULL ELSE split_part(k, ':', 1) END AS provider, list_last(string_split(split_part(url, '?', 1), '/')) AS name FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN 'pexels:' WHEN 1 THEN 'http:' ELSE 'unknown:' END || page_id AS k FROM pages)")
def x14(spark, d):
    """What stands before the colon, but for a list of no providers; and the last part of a path."""
    before = F.split_part(F.concat(F.element_at(F.array(*map(F.lit, ("pexels:", "http:", "unknown:"))), (F.col("page_id") % 3 + 1).cast("int")), "page_id"), F.lit(":"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.when(~before.isin("http", "unknown"), before).alias("provider"), F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/"), F.lit(-1)).alias("name"))


@query("x17_synonyms", "SELECT p_partkey, list_sort(list_distinct(list_concat(string_split(p_name, ' '), CASE WHEN contains(p_name, 'ring') THEN ['band', 'loop'] ELSE [] END, CASE WHEN contains(p_name, 'red') THEN ['rood'] ELSE [] END))) AS tags FROM part")
def x17(spark, d):
    """A part's words with the synonyms of each, sorted."""
    synonyms = F.create_map(F.lit("ring"), F.array(F.lit("band"), F.lit("loop")), F.lit("red"), F.array(F.lit("rood")))
    words = F.split("p_name", " ")
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(synonyms, w), F.array().cast("array<string>"))))
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_distinct(F.concat(words, more))).alias("tags"))


@query("x18_query_templates", "SELECT p_partkey, flatten(list_transform(string_split(p_name, ' '), lambda e: list_transform(['factory', 'history', 'aerial view'], lambda n: e || ' ' || n))) AS queries FROM part")
def x18(spark, d):
    """Every entity with every noun of the templates."""
    nouns = F.array(*map(F.lit, ("factory", "history", "aerial view")))
    return table(spark, d, "part").select("p_partkey", F.flatten(F.transform(F.split("p_name", " "), lambda e: F.transform(nouns, lambda n: F.concat_ws(" ", e, n)))).alias("queries"))


@query("x20_normalised_key", "SELECT doc_id, sha256(lower(trim(coalesce(lang, ''))) || '|' || lower(trim(coalesce(source, '')))) AS key FROM documents")
def x20(spark, d):
    """Parts are trimmed and lowered before they are joined and hashed."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", part("lang"), part("source")).cast("binary"), 256).alias("key"))


@query("x21_text_hash", "SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS hash FROM customer")
def x21(spark, d):
    """The hash h * 31 + character, in 32 bits."""
    codes = F.transform(F.split("c_name", ""), lambda c: F.ascii(c).cast("long"))
    return table(spark, d, "customer").select("c_custkey", F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296).alias("hash"))


_DHASH = "list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: CASE WHEN embedding[i] < embedding[i + 1] THEN 1::BIGINT ELSE 0::BIGINT END)), lambda h, b: h * 2 + b)"


@query("x22_dhash", f"SELECT vec_id, {_DHASH} AS hash FROM embeddings")
def x22(spark, d):
    """56 bits of 8 x 8 values: whether each is less than its right neighbour."""
    return table(spark, d, "embeddings").select("vec_id", N.dhash(F.col("embedding")).alias("hash"))


@query("x24_cosine", "WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(CASE WHEN y IS NULL THEN 0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 6) AS cosine, CAST(greatest(0, least(10, floor(round(CASE WHEN y IS NULL THEN 0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 6) * 40 + 0.5))) AS DOUBLE) AS points FROM p")
def x24(spark, d):
    """X-24 and X-25: the cosine with the next vector, 0 where lengths differ or one is missing; and as 0 to 10 points."""
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    rows = a.join(b, "vec_id", "left").select("vec_id", F.round(N.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))
    return rows.withColumn("points", N.clamp(F.floor(F.col("cosine") * 40 + 0.5).cast("double"), 0.0, 10.0))


@query("x26_clamp_lerp", "SELECT p_partkey, round(5 + (20 - 5) * greatest(0, least(1, (p_retailprice - 1000) / 700)), 6) AS y FROM part")
def x26(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(N.lerp(F.lit(5.0), F.lit(20.0), N.clamp((F.col("p_retailprice") - 1000) / 700)), 6).alias("y"))


@query("x28_overlap", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(l_quantity + 10, 40) - greatest(l_quantity, 15)) AS seconds, round(greatest(0, least(l_quantity + 10, 40) - greatest(l_quantity, 15)) / 10, 6) AS ratio FROM lineitem")
def x28(spark, d):
    """Seconds that two ranges share, and their part of the shorter one."""
    seconds = N.overlap(F.col("l_quantity"), F.col("l_quantity") + 10, F.lit(15.0), F.lit(40.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seconds.alias("seconds"), F.round(seconds / 10, 6).alias("ratio"))


@query("x29_day_key", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def x29(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("x30_age", "SELECT o_orderkey, date_diff('day', o_orderdate, DATE '2002-01-01') AS days, date_diff('day', o_orderdate, DATE '2002-01-01') > 900 AS stale FROM orders")
def x30(spark, d):
    days = F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), (days > 900).alias("stale"))


@query("x31_remaining", "SELECT event_id, CASE WHEN p <= 2 OR p >= 100 THEN NULL ELSE greatest(1, floor(value * (100 - p) / p + 0.5)) END AS seconds FROM (SELECT event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS p FROM events)")
def x31(spark, d):
    """What is left at the pace so far; unknown at the very start and at the end."""
    p = F.from_json("props", "k long")["k"]
    left = F.greatest(F.lit(1.0), F.floor(F.col("value") * (100 - F.col("p")) / F.col("p") + 0.5).cast("double"))
    return table(spark, d, "events").select("event_id", "value", p.alias("p")).select("event_id", F.when((F.col("p") > 2) & (F.col("p") < 100), left).alias("seconds"))


@query("x32_stage", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'Queued' WHEN event_type IN ('refund', 'error') THEN 'Completed' WHEN regexp_matches(s, 'upload|export') THEN 'Uploading' WHEN regexp_matches(s, 'stitch|montage') THEN 'Rendering' WHEN regexp_matches(s, 'scene \\d') THEN 'Searching Media' WHEN event_type = 'view' THEN 'Generating Voice' ELSE 'Preparing' END AS stage
  FROM (SELECT *, ['uploading', 'stitch it', 'scene 4', 'scene x', 'waiting'][event_id % 5 + 1] AS s FROM events)""")
def x32(spark, d):
    """A canonical stage from a status and free text; the status decides where the text says nothing."""
    texts = F.array(*map(F.lit, ("uploading", "stitch it", "scene 4", "scene x", "waiting")))
    rows = table(spark, d, "events").select("event_id", "event_type", F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int")).alias("s"))
    kind, s = F.col("event_type"), F.col("s")
    stage = F.when(kind == "signup", "Queued").when(kind.isin("refund", "error"), "Completed").when(s.rlike("upload|export"), "Uploading").when(s.rlike("stitch|montage"), "Rendering").when(s.rlike(r"scene \d"), "Searching Media").when(kind == "view", "Generating Voice").otherwise("Preparing")
    return rows.select("event_id", stage.alias("stage"))


@query("x33_cost", "SELECT event_id, round(value * 1000 / 1000000 * CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 0.8 ELSE 15 END, 9) AS cost FROM events")
def x33(spark, d):
    """Per million tokens by model; an unknown one costs as much as the dearest."""
    price = F.create_map(F.lit("click"), F.lit(3.0), F.lit("view"), F.lit(0.8))
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * 1000 / 1000000 * F.coalesce(F.try_element_at(price, "event_type"), F.lit(15.0)), 9).alias("cost"))


@query("x34_remap", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'standard' END AS state FROM orders")
def x34(spark, d):
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, "o_orderstatus"), F.lit("standard")).alias("state"))


@query("x35_groups", """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), g AS (SELECT *, unnest(range(0, 3)) AS g FROM r)
  SELECT conv_id, turn, i, min(g) AS grp FROM g WHERE i >= floor(g * n / 3 + 0.5) AND i < greatest(floor(g * n / 3 + 0.5) + 1, CASE WHEN g = 2 THEN n ELSE floor((g + 1) * n / 3 + 0.5) END) GROUP BY conv_id, turn, i""")
def x35(spark, d):
    """Rows of a group in three contiguous parts with rounded bounds; a part has one row at least, so that a row may be in two (the first counts)."""
    by = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(by.orderBy("turn", "role", "text")) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    parts = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda g: (F.col("i") >= F.floor(g * F.col("n") / 3 + 0.5)) & (F.col("i") < F.greatest(F.floor(g * F.col("n") / 3 + 0.5) + 1, F.when(g == 2, F.col("n")).otherwise(F.floor((g + 1) * F.col("n") / 3 + 0.5)))))
    return rows.select("conv_id", "turn", "i", F.array_min(parts).cast("long").alias("grp")).where("grp IS NOT NULL")


@query("x36_coercion", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'text ' || event_id WHEN 2 THEN 'true' END AS text FROM events")
def x36(spark, d):
    """A JSON value of any kind as text; null stays null."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"v": '), "event_id", F.lit("}"))).when(k == 1, F.concat(F.lit('{"v": "text '), "event_id", F.lit('"}'))).when(k == 2, F.lit('{"v": true}')).otherwise(F.lit('{"v": null}'))
    return table(spark, d, "events").select("event_id", F.get_json_object(raw, "$.v").alias("text"))


@query("x37_words", r"""WITH c AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS i, text FROM benchmark), f AS (SELECT item_id, i, substr(text, i, 1) AS ch, sum(CASE WHEN substr(text, i, 1) IN (' ', chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS w FROM c)
  SELECT item_id, string_agg(ch, '' ORDER BY i) AS word, round((min(i) - 1) * 0.06, 4) AS start, round(max(i) * 0.06, 4) AS "end" FROM f WHERE ch NOT IN (' ', chr(10)) GROUP BY item_id, w""")
def x37(spark, d):
    """Characters with times as words with their start and end."""
    chars = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("i", "ch")).where(F.length("ch") > 0)
    blank = F.col("ch").isin(" ", "\n")
    words = chars.withColumn("w", F.sum(blank.cast("int")).over(Window.partitionBy("item_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    by = words.groupBy("item_id", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda x: x["ch"]), "").alias("word"), F.min("i").alias("a"), F.max("i").alias("b"))
    return by.select("item_id", "word", F.round(F.col("a") * 0.06, 4).alias("start"), F.round((F.col("b") + 1) * 0.06, 4).alias("end"))


@query("x39_rebase", "SELECT user_id, event_id, greatest(0, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) - 60000000) AS local_us FROM events")
def x39(spark, d):
    """Times in microseconds from the scene's start (a minute after its first row), not below 0."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", "event_id", F.greatest(F.lit(0), t - F.min(t).over(Window.partitionBy("user_id")) - 60_000_000).alias("local_us"))


@query("x40_stall_threshold", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice > 200000 THEN 90 WHEN o_totalprice > 100000 THEN 60 ELSE 30 END WHEN o_orderstatus = 'O' THEN 20 ELSE 10 END AS minutes FROM orders")
def x40(spark, d):
    price = F.col("o_totalprice")
    long = F.when(price > 200000, 90).when(price > 100000, 60).otherwise(30)
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", long).when(F.col("o_orderstatus") == "O", 20).otherwise(10).alias("minutes"))


@query("t02_stalled", """WITH l AS (SELECT user_id, max(ts) AS last, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
  SELECT user_id, attempts, CASE WHEN last >= now - INTERVAL 90 MINUTE THEN 'running' WHEN attempts < 12 THEN 'requeue' ELSE 'fail' END AS action FROM l, n""")
def t02(spark, d):
    """Without news for the threshold a row is queued again, and failed after so many attempts; at the time of the last event."""
    return lifecycle.stalled(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 90, 12)


@query("t03_expired", "WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, min(ts) AS born, max(ts) AS last, sum(value) AS budget FROM events GROUP BY user_id) SELECT user_id, date_diff('second', born, now) > greatest(budget * 900, 36000) AND date_diff('second', last, now) > 3600 AS expired FROM l, n")
def t03(spark, d):
    """Older than one and a half budgets (or a floor), and stale as well."""
    return lifecycle.expired(table(spark, d, "events"), "user_id", "ts", F.sum("value") * 900, 36000, 3600)


@query("t09_ttl_cache", """WITH RECURSIVE r AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT user_id, event_type, event_id, k, t AS stored, false AS hit FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.event_type, r.event_id, r.k, CASE WHEN r.t - s.stored <= 7200000000 THEN s.stored ELSE r.t END, r.t - s.stored <= 7200000000 FROM s JOIN r ON s.user_id = r.user_id AND s.event_type = r.event_type AND r.k = s.k + 1)
  SELECT user_id, event_id, hit FROM s""")
def t09(spark, d):
    """A lookup hits where its key was stored within the time to live; a miss stores it, a hit doesn't renew it."""
    return lifecycle.ttl_hits(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 7200).select("user_id", "event_id", "hit")


@query("t10_retention", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 40")
def t10(spark, d):
    """The last forty rows of each key stay."""
    return ranking.top(table(spark, d, "events"), "user_id", [F.desc("event_id")], 40).select("user_id", "event_id")


@query("t07_flushes", """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT user_id, event_id, k, t AS first, 1 AS n, 1 AS flush FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.event_id, r.k, CASE WHEN s.n >= 5 OR r.t - s.first >= 7200000000 THEN r.t ELSE s.first END, CASE WHEN s.n >= 5 OR r.t - s.first >= 7200000000 THEN 1 ELSE s.n + 1 END, CASE WHEN s.n >= 5 OR r.t - s.first >= 7200000000 THEN s.flush + 1 ELSE s.flush END FROM s JOIN r ON s.user_id = r.user_id AND r.k = s.k + 1)
  SELECT user_id, flush, count(*) AS n FROM s GROUP BY user_id, flush""")
def t07(spark, d):
    """A buffer is flushed at five rows, or when a row comes two hours after its first."""
    return lifecycle.flushes(table(spark, d, "events"), "user_id", "ts", "event_id", 5, 7200)


@query("t05_rate_limit", """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT user_id, event_id, k, t AS first, 1 AS n, true AS allowed FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.event_id, r.k, CASE WHEN r.t - s.first >= 3600000000 THEN r.t ELSE s.first END, CASE WHEN r.t - s.first >= 3600000000 THEN 1 ELSE s.n + 1 END, r.t - s.first >= 3600000000 OR s.n < 3 FROM s JOIN r ON s.user_id = r.user_id AND r.k = s.k + 1)
  SELECT user_id, event_id, allowed FROM s""")
def t05(spark, d):
    """Three an hour; the hour begins with the first request after the one before ended (streaming form: tessera.streaming.feeds)."""
    return lifecycle.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 3600)


@query("t12_new_since_run", """WITH b AS (SELECT event_id, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS run FROM events) SELECT run, count(*) AS taken, CAST(min(event_id) AS BIGINT) AS first FROM b GROUP BY run""")
def t12(spark, d):
    """A backfill that is interrupted three times: each run takes what lies beyond the cursor of the one before."""
    events = table(spark, d, "events").select("event_id")
    top = events.agg((F.max("event_id") + 1).alias("_top"))  # one row
    runs = events.crossJoin(F.broadcast(top)).select("event_id", F.floor(F.col("event_id") * 4 / F.col("_top")).alias("run"))
    return runs.groupBy("run").agg(n_rows().alias("taken"), F.min("event_id").alias("first"))


@query("t13_idempotent_enqueue", "SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS job, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS asked FROM events GROUP BY ALL")
def t13(spark, d):
    """Of requests with one job id the first counts (streaming form: tessera.streaming.feeds)."""
    rows = table(spark, d, "events").select("user_id", F.from_json("props", "k long")["k"].alias("job"), "ts", "event_id")
    return rows.groupBy("user_id", "job").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), n_rows().alias("asked"))
