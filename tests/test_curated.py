"""The curated score's rules one by one, each by hand, and rows where everything is missing."""

from tessera.functions import curated

SCHEMA = """id string, clip struct<tags: array<string>, moving: boolean, seconds: int, own_theme: boolean, wrong_place: boolean, unfit: boolean, rejected: boolean, notation: boolean, extra: int, audit: int, shows: array<string>>,
  beat struct<text: string, tags: array<string>, visual: array<string>, places: array<string>, anchors: array<string>, topics: array<string>, kinds: map<string, array<string>>, scene: int, theme: boolean, theme_video: boolean>"""

#: name: (clip, beat, score by hand)
CASES = {
    "nothing": ({}, {}, 0),
    "empty lists": ({"tags": []}, {"text": "", "tags": [], "places": [], "anchors": [], "topics": []}, 0),
    "person: 200, three hits": ({"tags": ["anna", "anna b"]}, {"text": "Here is Anna B"}, 200 + 150 + 80),
    "short tags name no person": ({"tags": ["ann"]}, {"text": "Ann"}, 0),
    "equal and held": ({"tags": ["ring", "rings"]}, {"tags": ["ring"]}, 42 + 16 + 150),
    "one hit, moving": ({"tags": ["ring"], "moving": True, "seconds": 9}, {"tags": ["ring"]}, 42 + 22),
    "two hits, moving, long": ({"tags": ["ring"], "moving": True, "seconds": 3}, {"tags": ["ring"], "visual": ["rin"]}, 42 + 22 + 150 + 70),
    "moving, no length": ({"tags": ["ring"], "moving": True}, {"tags": ["ring"], "visual": ["rin"]}, 42 + 22 + 150 + 58),
    "no hits for two asked: floor after -60": ({"tags": ["x"], "audit": 3}, {"tags": ["a", "b"], "text": "t", "places": ["c"]}, 0 + 3),
    "no place: -60 stays without two asked": ({"tags": ["x"]}, {"text": "t", "places": ["c"]}, -60),
    "places need a text": ({"tags": ["c"]}, {"text": "  ", "places": ["c"]}, 0),
    "one place": ({"tags": ["c"]}, {"text": "t", "places": ["c"]}, 50),
    "two places": ({"tags": ["c", "d"]}, {"text": "t", "places": ["c", "d"]}, 85 + 150),
    "wrong place: floor before the bonus": ({"tags": ["c", "d"], "wrong_place": True}, {"text": "t", "places": ["c", "d"]}, 150),
    "kind shown": ({"tags": ["car"], "shows": ["cars"]}, {"kinds": {"cars": ["car", "ca"]}}, 55 + 36 + 150),
    "kind not shown": ({"tags": ["car"]}, {"kinds": {"cars": ["car"]}}, -140),
    "anchors": ({"tags": ["old town"]}, {"anchors": ["old", "town"], "scene": 7}, 48 + 150 + 7),
    "one anchor is none": ({"tags": ["old town"]}, {"anchors": ["old"]}, 0),
    "topics named and not": ({"tags": ["ab", "abc"]}, {"text": "ab", "topics": ["ab", "abc"]}, 16 + 6 + 5 + 2),
    "own theme": ({"own_theme": True}, {"theme": True}, 40),
    "off theme": ({"own_theme": True, "tags": ["ring"], "audit": 5}, {"tags": ["ring"], "visual": ["ring"]}, 5),
    "theme of the video": ({"own_theme": True, "tags": ["ring"]}, {"tags": ["ring"], "theme_video": True}, 42),
    "barred": ({"tags": ["ring"], "notation": True, "audit": 9}, {"tags": ["ring"]}, 0),
}


def test_rules_by_hand(spark):
    clip_fields = [f.name for f in spark.createDataFrame([], SCHEMA).schema["clip"].dataType]
    beat_fields = [f.name for f in spark.createDataFrame([], SCHEMA).schema["beat"].dataType]
    rows = [(n, {f: c.get(f) for f in clip_fields}, {f: b.get(f) for f in beat_fields}) for n, (c, b, _) in CASES.items()] + [("null structs", None, None)]
    got = {r["id"]: r["score"] for r in curated.scored(spark.createDataFrame(rows, SCHEMA), ["cars", "cycling"]).collect()}
    assert got == {n: want for n, (*_, want) in CASES.items()} | {"null structs": 0}
