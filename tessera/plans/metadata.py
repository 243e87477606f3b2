"""Scores from stored metadata over the driver's tables. The tables have no annotations: columns for them are made of each part's key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bonuses, curated
from tessera.operators import sequences
from tessera.plans.book import book
from tessera.sources.tables import table

QUERIES, ORACLES, query = book()

PHRASES = [
    "An aerial view of the crowd: a speech, then applause and music",
    "He enters frame left to right, still, before the battle; smoke and fire",
    "A reaction to the explosion, shots and aircraft over the skyline",
    "The establishing overview, a detail and the climax of the parade",
    "Silence. The ending, a close-up interview about the archive",
    "She approaches, then retreats; a decisive change of feeling",
    "Radio broadcast of the march, drums, a victory and its celebration",
    "",
]
MOVES = [["enters frame left", "left→right"], ["approaches camera"], ["Away from Camera", "stationary"], ["exits frame"], []]
SOUNDS = [["Crowd noise", "speech"], ["loud event"], ["music", "applause"], ["silence", "radio"], ["engines"], []]
PICTURES = [["aerial view", "crowd shot", "skyline"], ["Reaction shot", "fire", "smoke"], ["interview", "close detail"], ["battle", "archive footage", "celebration"], []]
STORIES = [["establishing", "context"], ["action", "climax"], ["reaction"], ["ending", "detail"], ["reveal", "transition"]]
INTENTS = [["crowds", "aerial view", "battle", "music"], ["reaction", "celebration"], ["An Overview", "parade"], []]
ENTITIES = [None, "Old Ring", "Hot Gear Bolt", ""]
TOPICS = [[("crowd and speech", 90), ("old music", 60)], [("decisive battle", 75)], [("archive of victory", 100), ("smoke", 30)], []]
NEGATIVE = [["NOT ring", "NOT hot bolt"], ["smoke", "not of", "NOT battle"], ["crowd"], []]
NEEDS = [["show", "explain", "prove"], ["show"], [], ["explain", "compare"]]
SPOILS = [["distract"], ["prove", "distract"], []]


def _pick(lists: list, k):
    """The list (or text) of that number, as a literal column."""
    one = lambda v: v if v is None or isinstance(v, str) else [one(x) for x in v]
    cells = [F.lit(v).cast("string") if v is None or isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") for v in map(one, lists)]
    return F.element_at(F.array(*cells), (k % len(lists) + 1).cast("int"))


def _told(tags: str, rules: list, same: bool = False) -> str:
    hit = lambda w: f"t = '{w}'" if same else f"contains(t, '{w}')"
    return " + ".join(f"CASE WHEN regexp_matches(text, '{p}') AND len(list_filter({tags}, lambda t: {' OR '.join(map(hit, wanted))})) > 0 THEN {n} ELSE 0 END" for p, wanted, n in rules)


def _sql(lists: list, n: str = "k") -> str:
    return f"{lists}[{n} % {len(lists)} + 1]".replace("None", "NULL")


_TOPICS = str([[{"topic": t, "score": s} for t, s in x] for x in TOPICS])
_CAPS = "{'show': k % 101, 'explain': k * 7 % 101, 'prove': k * 3 % 101, 'distract': k * 11 % 101, 'compare': 0}"
_STEP = lambda c: f"CASE WHEN {c} >= 80 THEN 3 WHEN {c} >= 60 THEN 2 WHEN {c} >= 40 THEN 1 ELSE 0 END"


@query("r24_metadata_terms", f"""WITH c AS (SELECT p_partkey, p_partkey AS k, p_name, p_type, lower({_sql(PHRASES, "p_partkey")} || ' ' || p_name) AS text FROM part),
  d AS (SELECT *, list_transform({_sql(MOVES)}, lambda x: lower(x)) AS moves, list_transform({_sql(SOUNDS, "(k // 3)")}, lambda x: lower(x)) AS sounds, list_transform({_sql(PICTURES, "(k // 2)")}, lambda x: lower(x)) AS pictures, {_sql(STORIES, "(k // 5)")} AS stories,
    list_transform({_sql(INTENTS, "(k // 7)")}, lambda x: lower(x)) AS intents, lower({_sql(ENTITIES, "(k // 2)")}) AS entity, {_TOPICS}[(k // 3) % {len(TOPICS)} + 1] AS topics,
    list_filter(list_transform({_sql(NEGATIVE, "(k // 4)")}, lambda t: trim(regexp_replace(lower(t), '^not\\s+', ''))), lambda t: length(t) >= 3 AND contains(text, t)) AS against, {_sql(NEEDS, "(k // 9)")} AS needs, {_sql(SPOILS, "(k // 2)")} AS spoils, (k * 7 % 100) / 100 - coalesce(CASE WHEN k % 9 <> 0 THEN (k * 11 % 100) / 100 END, 0.5) AS gain,
    list_transform(needs, lambda n: CASE n WHEN 'show' THEN k % 101 WHEN 'explain' THEN k * 7 % 101 WHEN 'prove' THEN k * 3 % 101 ELSE 0 END) AS able, list_transform(spoils, lambda n: CASE n WHEN 'prove' THEN k * 3 % 101 ELSE k * 11 % 101 END) AS spoiled FROM c),
  f AS (SELECT *, CASE WHEN coalesce(entity, '') = '' THEN CASE WHEN k % 2 = 0 AND k % 10 >= 5 AND k % 4 >= 2 THEN 3 ELSE 0 END
      WHEN len(list_filter(string_split(entity, ' '), lambda t: length(t) > 2 AND contains(p_name, t))) = 0 THEN 0 ELSE least(6, 2 + CASE WHEN (k % 10) / 10 > 0.6 THEN 4 WHEN (k % 10) / 10 > 0.3 THEN 2 ELSE 0 END + CASE WHEN k % 4 >= 2 THEN 2 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) END AS face,
    len(list_filter(intents, lambda t: length(t) > 4 AND (contains(text, t) OR contains(t, string_split(text, ' ')[1])))) AS meant,
    list_max(list_transform(topics, lambda e: floor(len(list_filter(string_split(e.topic, ' '), lambda t: length(t) > 3 AND contains(text, t))) / greatest(1, len(list_filter(string_split(e.topic, ' '), lambda t: length(t) > 3))) * (e.score / 100) * 4 + 0.5))) AS topical,
    CASE WHEN k % 5 <> 0 THEN k * 13 % 101 ELSE floor((k % 101 + k * 3 % 101 + k * 5 % 101) / 3 + 0.5) END AS clean FROM d),
  t AS (SELECT p_partkey, CASE WHEN gain > 0.02 THEN least(6, floor(gain / 0.025 + 0.5)) ELSE 0 END AS segment, face, least(4, {_told("moves", bonuses.MOVEMENTS)}) AS object,
    least(5, CASE WHEN k % 6 = 0 AND len(list_filter(sounds, lambda t: contains(t, 'music'))) > 0 THEN 3 ELSE 0 END + {_told("sounds", bonuses.SOUNDS)}) AS audio, least(6, CASE WHEN k % 4 = 0 AND len(list_filter(pictures, lambda t: contains(t, 'fire'))) > 0 THEN 2 ELSE 0 END + {_told("pictures", bonuses.PICTURES)}) AS cinematic,
    CASE WHEN k % 13 = 0 THEN 0 ELSE greatest(0, least(5, floor((k % 101 - 50) / 10 + 0.5))) END AS importance, greatest(0, least(3, floor((k * 3 % 101 - 50) / 17 + 0.5))) AS uniqueness, least(4, {_told("stories", bonuses.STORIES, True)}) AS storytelling,
    CASE WHEN clean >= 85 THEN 3 WHEN clean >= 70 THEN 2 WHEN clean >= 55 THEN 1 ELSE 0 END AS quality, CASE WHEN k * 17 % 101 >= 80 THEN 2 WHEN k * 17 % 101 >= 60 THEN 1 ELSE 0 END AS health,
    CASE WHEN k % 4 = 1 THEN 0 WHEN k % 4 = 0 OR contains(text, lower(p_type)) THEN 6 WHEN meant >= 3 THEN 4 WHEN meant >= 1 THEN 2 ELSE 0 END AS subject, least(4, coalesce(topical, 0)) AS priority, greatest(-5, -3 * len(against)) AS negative,
    CASE WHEN len(needs) = 0 THEN 0 ELSE least(8, list_sum(list_transform(able, lambda s: {_STEP("s")}))) END AS capability, CASE WHEN len(needs) = 0 THEN 0 ELSE -least(6, list_sum(list_transform(able, lambda s: CASE WHEN s < 20 THEN 1 ELSE 0 END)) + coalesce(list_sum(list_transform(spoiled, lambda s: {_STEP("s")})), 0)) END AS incapability,
    CASE WHEN k % 7 > 0 THEN CASE WHEN k % 7 >= 6 THEN 0 ELSE floor(coalesce(greatest(CASE WHEN 3 <= k % 7 + 1.5 THEN k * 19 % 101 END, CASE WHEN 5 <= k % 7 + 1.5 THEN k * 23 % 101 END), 0) / 100 * 5 + 0.5) END WHEN k % 2 = 0 THEN 1 ELSE 0 END AS temporal FROM f),
  n AS (SELECT p_partkey, CAST(COLUMNS(* EXCLUDE p_partkey) AS BIGINT) FROM t)
  SELECT *, segment + face + object + audio + cinematic + importance + uniqueness + storytelling + quality + health + subject + priority + negative + capability + incapability + temporal AS total FROM n""")
def r24_terms(spark, d):
    """R-24 in full: what the metadata of each part, as a clip, add for a beat by sixteen terms, and their sum."""
    k = F.col("p_partkey")
    of = lambda n: F.floor(k / n)
    point = lambda factor: k * factor % 101
    struct = lambda **cells: F.struct(*(c.alias(n) for n, c in cells.items()))
    topics = [F.array(*(struct(topic=F.lit(t), score=F.lit(s)) for t, s in x)) if x else F.array().cast("array<struct<topic:string,score:int>>") for x in TOPICS]
    caps = F.create_map(F.lit("show"), k % 101, F.lit("explain"), point(7), F.lit("prove"), point(3), F.lit("distract"), point(11))
    clip = {
        "segments": F.array(k * 7 % 100 / 100), "similarity": F.when(k % 9 != 0, k * 11 % 100 / 100),
        "faces": F.array(struct(name=F.col("p_name"), share=k % 10 / 10, close=k % 4, main=k % 2 == 0)),
        "objects": F.transform(_pick(MOVES, k), lambda x: struct(movement=F.lit("moves"), direction=x)),
        "sounds": _pick(SOUNDS, of(3)), "pictures": _pick(PICTURES, of(2)), "importance": F.when(k % 13 != 0, k % 101), "uniqueness": point(3), "stories": _pick(STORIES, of(5)),
        "quality": F.when(k % 5 != 0, point(13)), "block": struct(overall=k % 101, sharpness=point(3), stability=point(5)), "health": point(17),
        "subject": F.when(k % 4 == 0, F.col("p_name")).when(k % 4 != 1, F.col("p_type")), "intents": _pick(INTENTS, of(7)),
        "topics": F.element_at(F.array(*topics), (of(3) % len(TOPICS) + 1).cast("int")), "negative": _pick(NEGATIVE, of(4)), "capabilities": caps,
        "windows": F.array(struct(duration=F.lit(3), score=point(19)), struct(duration=F.lit(5), score=point(23))), "duration": F.lit(6), "highlights": F.sequence(F.lit(1), F.lit(1) + (k % 2).cast("int")),
    }
    clip["highlights"] = F.slice(clip["highlights"], F.lit(1), F.lit(1) - (k % 2).cast("int"))
    none = F.array().cast("array<string>")
    beat = {
        "text": F.concat_ws(" ", _pick(PHRASES, k), F.col("p_name")), "entity": _pick(ENTITIES, of(2)), "sounds": F.when(k % 6 == 0, F.array(F.lit("Music"))).otherwise(none),
        "pictures": F.when(k % 4 == 0, F.array(F.lit("Fire"))).otherwise(none), "required": _pick(NEEDS, of(9)), "unwanted": _pick(SPOILS, of(2)), "duration": k % 7,
    }
    rows = table(spark, d, "part").select("p_partkey", *(c.alias(f"clip_{n}") for n, c in clip.items()), *(c.alias(f"beat_{n}") for n, c in beat.items()))
    terms = bonuses.metadata(lambda n: F.col(f"clip_{n}"), lambda n: F.col(f"beat_{n}"))
    rows = rows.select("p_partkey", *(c.cast("long").alias(n) for n, c in terms.items()))
    return rows.withColumn("total", sum((F.col(n) for n in terms), F.lit(0)))


@query("r22_context_rank", """WITH s AS (SELECT p_partkey, p_size % 5 AS beat, greatest(0, least(100, floor((40 * p_size * 2 + 25 * floor(p_retailprice / 20) + 15 * (p_partkey % 101) + 10 * (p_partkey * 7 % 101) + 10 * (p_partkey * 13 % 101) + CASE WHEN p_brand LIKE '%1%' THEN 400 ELSE 0 END - CASE WHEN p_partkey % 6 = 0 THEN 3000 ELSE 0 END + 50) / 100))) AS score FROM part)
  SELECT p_partkey, beat, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY beat ORDER BY score DESC, p_partkey) AS place FROM s""")
def r22_rank(spark, d):
    """R-22's score in whole points (hundredths are added as whole numbers) and its rank within a beat, the first candidate among equals. A beat's candidates are numbered by equal scores
    and by stretches of their keys, not in one task."""
    k = F.col("p_partkey")
    parts = 40 * F.col("p_size") * 2 + 25 * F.floor(F.col("p_retailprice") / 20) + 15 * (k % 101) + 10 * (k * 7 % 101) + 10 * (k * 13 % 101)
    score = F.floor((parts + F.when(F.col("p_brand").contains("1"), 400).otherwise(0) - F.when(k % 6 == 0, 3000).otherwise(0) + 50) / 100)
    rows = table(spark, d, "part").select(k, (F.col("p_size") % 5).alias("beat"), F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"))
    rows = rows.withColumn("stretch", F.struct((-F.col("score")).alias("less"), F.floor(k / 100_000).alias("keys")))
    return sequences.numbered(rows, ["beat"], "stretch", ["p_partkey"], "place").select("p_partkey", "beat", "score", "place")


TAGS = [["crowd", "old town"], ["ring", "battle"], ["bicycle race"], ["gear", "car", "road"], ["parliament"], []]
ASKED = [["ring", "gear"], ["crowd"], ["battle", "car", "road"], []]
PLACES = [["town", "old"], ["river"], [], ["road"]]
WANTED = [("cycling", ["race"]), ("cars", ["car", "gear"]), ("government", ["parliament"])]
_NEAR = "contains(t, q) OR contains(q, t)"


def _hits(asked: str, test: str = _NEAR) -> str:
    return f"coalesce(list_sum(list_transform({asked}, lambda q: len(list_filter(tags, lambda t: {test})))), 0)"


def _wants(j: int) -> str:
    kind, tags = WANTED[j]
    return f"CASE WHEN p_size % 4 <> {j} THEN 0 WHEN k % 5 = {j} THEN 55 + 18 * {_hits(str(tags))} ELSE -140 END"


@query("r21_curated_score", f"""WITH a AS (SELECT p_partkey, p_size, p_partkey AS k, lower(p_name) AS text, list_append({_sql(TAGS, "p_partkey")}, lower(p_type)) AS tags, {_sql(ASKED, "(p_partkey // 3)")} AS asked, {_sql(PLACES, "(p_partkey // 2)")} AS places FROM part),
  b AS (SELECT *, len(list_filter(tags, lambda t: length(t) >= 4 AND contains(text, t))) > 0 AS named, {_hits("asked", "q = t")} AS equal, {_hits("asked")} AS held, {_hits("['old', 'race']")} AS seen, {_hits("places")} AS sited FROM a),
  c AS (SELECT *, CASE WHEN named THEN 200 ELSE 0 END + 42 * equal + 16 * (held - equal) + 22 * seen AS s, CASE WHEN named THEN 3 ELSE 0 END + held + seen AS h FROM b),
  d AS (SELECT * REPLACE (s + CASE WHEN len(places) = 0 THEN 0 WHEN sited >= 2 THEN 85 WHEN sited = 1 THEN 50 WHEN h < 2 THEN -60 ELSE 0 END AS s, h + CASE WHEN len(places) = 0 THEN 0 ELSE least(2, sited) END AS h) FROM c),
  e AS (SELECT * REPLACE (CASE WHEN len(places) > 0 AND k % 11 = 0 THEN greatest(0, s - 250) ELSE s END + {_wants(0)} + {_wants(1)} + {_wants(2)} AS s, h + CASE WHEN p_size % 4 < 3 AND k % 5 = p_size % 4 THEN 2 ELSE 0 END AS h) FROM d),
  f AS (SELECT *, contains(array_to_string(tags, ' '), 'old') AND contains(array_to_string(tags, ' '), 'crowd') AS anchored FROM e),
  g AS (SELECT * REPLACE (s + CASE WHEN anchored THEN 48 ELSE 0 END + k % 3 * 10 AS s, h + CASE WHEN anchored THEN 2 ELSE 0 END AS h) FROM f),
  i AS (SELECT * REPLACE (s + CASE WHEN h >= 2 THEN 150 ELSE 0 END + CASE WHEN h >= 3 THEN 80 ELSE 0 END + list_sum(list_transform(['ring', 'road'], lambda q: coalesce(list_sum(list_transform(tags, lambda t: CASE WHEN t = q THEN CASE WHEN contains(text, q) THEN 16 ELSE 5 END WHEN {_NEAR} THEN CASE WHEN contains(text, q) THEN 6 ELSE 2 END ELSE 0 END)), 0))) AS s) FROM g),
  j AS (SELECT * REPLACE (CASE WHEN len(asked) >= 2 AND h = 0 THEN greatest(0, s - 60) ELSE s END + CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 40 ELSE 0 END - k % 2 * 95 + CASE WHEN k % 2 = 1 OR h = 0 THEN 0 WHEN h = 1 THEN 22 WHEN p_size >= 3 THEN 70 ELSE 58 END AS s) FROM i)
  SELECT p_partkey, CAST(CASE WHEN k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 THEN 0 ELSE CASE WHEN k % 4 = 0 AND k % 3 <> 0 AND k % 8 <> 0 THEN greatest(0, s - 400) ELSE s END + k % 7 END AS BIGINT) AS score FROM j""")
def r21_curated(spark, d):
    """R-21 in full: tags, places, kinds, anchors, topics and the floors between them; what can be told from a clip's data alone (format,
    looks, bars) comes as columns."""
    k = F.col("p_partkey")
    of = lambda n: F.floor(k / n)
    struct = lambda **cells: F.struct(*(c.alias(n) for n, c in cells.items()))
    words = lambda *xs: F.array(*map(F.lit, xs))
    kinds = [n for n, _ in WANTED]
    shows = F.coalesce(F.get(F.array(*(words(n) for n in kinds)), (k % 5).cast("int")), F.array().cast("array<string>"))
    wanted = F.map_from_entries(F.filter(F.array(*(F.struct(F.when(F.col("p_size") % 4 == j, n).alias("key"), words(*t).alias("value")) for j, (n, t) in enumerate(WANTED))), lambda e: e["key"].isNotNull()))
    clip = struct(
        tags=F.array_append(_pick(TAGS, k), F.lower("p_type")), moving=k % 2 == 0, seconds=F.col("p_size"), own_theme=k % 4 == 0, wrong_place=k % 11 == 0, unfit=k % 17 == 0, rejected=k % 19 == 0, notation=k % 23 == 0,
        extra=-(k % 2) * 95, audit=k % 7, shows=shows,
    )
    beat = struct(
        text=F.col("p_name"), tags=_pick(ASKED, of(3)), visual=words("old", "race"), places=_pick(PLACES, of(2)), anchors=words("old", "crowd"), topics=words("ring", "road"), kinds=wanted, scene=k % 3 * 10,
        theme=k % 3 == 0, theme_video=k % 8 == 0,
    )
    return curated.scored(table(spark, d, "part").select("p_partkey", clip.alias("clip"), beat.alias("beat")), kinds).select("p_partkey", "score")
