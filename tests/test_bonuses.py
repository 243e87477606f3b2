"""The sixteen metadata terms against a plain reading of their rules, with nulls, empty lists and clips without an annotation."""

import math
import random
import re

from pyspark.sql import functions as F

from tessera.functions import bonuses

CLIP = """struct<segments array<double>, similarity double, faces array<struct<name string, share double, close double, main boolean>>,
  objects array<struct<movement string, direction string>>, sounds array<string>, pictures array<string>, importance double, uniqueness double, stories array<string>, quality double,
  block struct<overall double, sharpness double, stability double>, health double, subject string, intents array<string>, topics array<struct<topic string, score double>>, negative array<string>,
  capabilities map<string, int>, windows array<struct<duration double, score double>>, duration double, highlights array<string>>"""
BEAT = "struct<text string, entity string, sounds array<string>, pictures array<string>, required array<string>, unwanted array<string>, duration double>"
SCHEMA = f"id int, clip {CLIP}, beat {BEAT}".replace("struct<segments", "struct<segments:").replace("struct<text", "struct<text:")


def _typed(schema):
    """"name type" fields of structs as "name: type"."""
    return re.sub(r"([<,]\s*)(\w+):? (?=(?:array|struct|map|string|double|boolean|int)\b)", r"\1\2: ", schema)


def _round(x):
    return math.floor(x + 0.5)


def _rules(text, tags, rules, same=False):
    return sum(n for p, wanted, n in rules if re.search(p, text, re.I) and any(t == w if same else w in t for t in tags for w in wanted))


def _terms(c, b):
    text = (b["text"] or "").lower()
    out = dict.fromkeys(("segment", "face", "object", "audio", "cinematic", "importance", "uniqueness", "storytelling", "quality", "health", "subject", "priority", "negative", "capability", "incapability", "temporal"), 0)
    if c["segments"]:
        gain = c["segments"][0] - (0.5 if c["similarity"] is None else c["similarity"])
        out["segment"] = min(6, _round(gain / 0.025)) if gain > 0.02 else 0
    tracks = c["faces"] or []
    if not b["entity"]:
        main = next((f for f in tracks if f["main"]), None)
        out["face"] = 3 if main and main["share"] >= 0.5 and main["close"] >= 2 else 0
    else:
        words = [w for w in b["entity"].lower().split() if len(w) > 2]
        f = next((f for f in tracks if any(w in f["name"].lower() for w in words)), None)
        if f:
            out["face"] = min(6, 2 + (4 if f["share"] > 0.6 else 2 if f["share"] > 0.3 else 0) + 2 * (f["close"] >= 2) + bool(f["main"]))
    out["object"] = min(4, _rules(text, [o[x].lower() for o in c["objects"] or [] for x in ("movement", "direction")], bonuses.MOVEMENTS))
    for name, rules, most, each in (("sounds", bonuses.SOUNDS, 5, 3), ("pictures", bonuses.PICTURES, 6, 2)):
        tags = [t.lower() for t in c[name] or []]
        asked = sum(each for a in b[name] or [] if any(a.lower() in t for t in tags))
        out["audio" if name == "sounds" else "cinematic"] = min(most, asked + _rules(text, tags, rules))
    for name, by, most in (("importance", 10, 5), ("uniqueness", 17, 3)):
        out[name] = 0 if c[name] is None else min(most, max(0, _round((c[name] - 50) / by)))
    out["storytelling"] = min(4, _rules(text, c["stories"] or [], bonuses.STORIES, True))
    clean = c["quality"] if c["quality"] is not None else c["block"] and _round(sum(c["block"].values()) / 3)
    out["quality"] = 0 if clean is None else (clean >= 85) + (clean >= 70) + (clean >= 55)
    out["health"] = 0 if c["health"] is None else (c["health"] >= 80) + (c["health"] >= 60)
    if c["subject"]:
        meant = sum(len(t) > 4 and (t.lower() in text or text.split(" ")[0] in t.lower()) for t in c["intents"] or [])
        out["subject"] = 6 if c["subject"].lower() in text else 4 if meant >= 3 else 2 if meant else 0
    for e in c["topics"] or []:
        words = [w for w in e["topic"].lower().split() if len(w) > 3]
        out["priority"] = max(out["priority"], min(4, _round(sum(w in text for w in words) / max(1, len(words)) * (e["score"] / 100) * 4)))
    for t in c["negative"] or []:
        term = re.sub(r"^NOT\s+", "", t, flags=re.I).strip().lower()
        out["negative"] = max(-5, out["negative"] - 3 * (len(term) >= 3 and term in text))
    if c["capabilities"] is not None and b["required"]:
        strength = lambda s: (s >= 80) + (s >= 60) + (s >= 40)
        got = [c["capabilities"].get(n, 0) for n in b["required"]]
        out["capability"] = min(8, sum(map(strength, got)))
        out["incapability"] = -min(6, sum(s < 20 for s in got) + sum(strength(c["capabilities"].get(n, 0)) for n in b["unwanted"] or []))
    if b["duration"] and b["duration"] > 0:
        fit = [w["score"] for w in c["windows"] or [] if w["duration"] <= b["duration"] + 1.5]
        out["temporal"] = _round(max(fit) / 100 * 5) if fit and c["duration"] is not None and b["duration"] < c["duration"] else 0
    else:
        out["temporal"] = int(bool(c["highlights"]))
    return out


def test_terms_equal_plain_rules(spark):
    draw = random.Random(11)
    words = ["crowd", "Speech", "music", "battle", "enters frame", "left to right", "reaction", "ending", "smoke", "aerial", "Old Anne", "still", "climax", "detail", "gunfire", "radio"]
    tags = ["crowd shot", "speech", "Music", "loud event", "enters frame left", "left→right", "reaction", "ending", "context", "smoke", "aerial view", "battle", "climax", "detail", "stationary", "old anne"]
    maybe = lambda make: None if draw.random() < 0.15 else make()
    some = lambda make, most=4: maybe(lambda: [make() for _ in range(draw.randrange(most + 1))])
    tag, number = lambda: draw.choice(tags), lambda: float(draw.randrange(101))
    rows = []
    for i in range(400):
        clip = {
            "segments": some(lambda: draw.random()), "similarity": maybe(draw.random), "faces": some(lambda: {"name": draw.choice(["Anne Old", "bob", "Eva"]), "share": draw.random(), "close": draw.random() * 4, "main": draw.random() < 0.5}),
            "objects": some(lambda: {"movement": tag(), "direction": tag()}), "sounds": some(tag), "pictures": some(tag), "importance": maybe(number), "uniqueness": maybe(number), "stories": some(tag), "quality": maybe(number) if i % 2 else None,
            "block": maybe(lambda: {"overall": number(), "sharpness": number(), "stability": number()}), "health": maybe(number), "subject": maybe(lambda: draw.choice([*tags, "", "none"])), "intents": some(tag),
            "topics": some(lambda: {"topic": f"{draw.choice(words)} of {draw.choice(words)}", "score": number()}), "negative": some(lambda: draw.choice(["NOT ", "not  ", ""]) + draw.choice([*words, "x"])),
            "capabilities": maybe(lambda: {n: draw.randrange(101) for n in "abc"}), "windows": some(lambda: {"duration": draw.randrange(20) / 2, "score": number()}), "duration": maybe(lambda: draw.randrange(20) / 2), "highlights": some(tag),
        }
        beat = {
            "text": maybe(lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(9)))), "entity": maybe(lambda: draw.choice(["Old  Anne", "Bob", "", "no"])), "sounds": some(tag, 2), "pictures": some(tag, 2),
            "required": some(lambda: draw.choice("abcd")), "unwanted": some(lambda: draw.choice("abcd")), "duration": maybe(lambda: draw.randrange(20) / 2),
        }
        rows.append((i, clip, beat))
    df = spark.createDataFrame(rows, _typed(SCHEMA))
    terms = bonuses.metadata(lambda n: F.col(f"clip.{n}"), lambda n: F.col(f"beat.{n}"))
    got = {r["id"]: r.asDict() for r in df.select("id", *(c.alias(n) for n, c in terms.items())).collect()}
    seen = {n: set() for n in terms}
    for i, clip, beat in rows:
        for name, want in _terms(clip, beat).items():
            assert got[i][name] == want, (i, name, clip, beat)
            seen[name].add(want)
    assert all(len(v) > 1 for v in seen.values()), "a term that is always the same shows nothing"
