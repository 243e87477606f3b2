"""Best windows over timelines and beats of spoken words, against plain walks; one key has most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import directing, intervals, sequences


def test_running_sums_compose_over_stretches(spark):
    draw = random.Random(4)
    rows = [(draw.choice("aaab"), i, draw.randrange(-3, 4), draw.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, x int, y int").withColumn("s", F.floor(F.col("i") / 7))
    got = {r["i"]: (r["x"], r["y"]) for r in sequences.running(df, ["k"], "s", "i", ["x", "y"]).collect()}
    sums = {}
    for k, i, x, y in rows:
        a, b = sums.get(k, (0, 0))
        sums[k] = (a + x, b + y)
        assert got[i] == sums[k]


def _windows(duration, segments, lengths):
    """All windows, one by one."""
    out = []
    for n in lengths:
        best = None
        for k in range(int((duration - n) * 2) + 1 if duration >= n else 0):
            inside = [s for s in segments if s[1] > k / 2 and s[0] < k / 2 + n]
            score = 50 if not segments else 30
            if inside:
                score = 50 + sum(p for c, p in ((2, 10), (3, 8), (4, 7), (5, 8)) if any(s[c] for s in inside))
                score += min(10, 4 * sum(bool(s[6]) for s in inside)) - 5 * (n > 10)
                score = max(0, min(100, score))
            if best is None or score > best[1]:
                best = (k / 2, score)
        if best:
            out.append((n, *best))
    return out


def test_best_windows_equal_all_windows(spark):
    """Gaps, overlapping segments, segments beyond the clip and empty ones, null flags, clips without segments or shorter than a window."""
    draw = random.Random(7)
    clips = [("long", 900.0), ("bare", 20.0), ("short", 4.0), ("tiny", 1.0), *((f"c{i}", draw.randrange(2, 80) / 2 + draw.random()) for i in range(25))]
    segments = []
    for key, duration in clips:
        for _ in range({"long": 400, "bare": 0}.get(key, draw.randrange(0, 7))):
            a = draw.choice([draw.uniform(0, duration + 3), float(draw.randrange(int(duration) + 1)), draw.randrange(2 * int(duration) + 1) / 2])
            segments.append((key, a, a + draw.choice([0.0, 0.25, 0.5, 3.0, draw.uniform(0, 9)]), *(draw.choice([True, False, False, None]) for _ in range(5))))
    schema = "key string, start double, end double, close boolean, persons boolean, emotion boolean, micro boolean, hit boolean"
    lengths = [3, 5, 8, 10, 12]
    found = intervals.best_windows(spark.createDataFrame(clips, "key string, duration double"), spark.createDataFrame(segments, schema), "key", lengths)
    got = sorted(tuple(r) for r in found.collect())
    want = [(k, *w) for k, d in clips for w in _windows(d, [s[1:] for s in segments if s[0] == k], lengths)]
    assert got == sorted(want)
    assert not [r for r in got if r[0] == "tiny"] and len([r for r in got if r[0] == "bare"]) == 5


def test_best_windows_of_keys_with_few_and_with_many_segments(spark):
    """Keys below and above the bound, with clips and where the last segment ends the clip; a key without segments."""
    draw, segments = random.Random(12), []
    for k in range(12):
        for _ in range(k * 4):
            a = draw.randrange(0, 80) / 4
            segments.append((k, a, a + draw.randrange(0, 30) / 4, *(draw.choice([True, False, None]) for _ in range(5))))
    rows = spark.createDataFrame(segments, "key long, start double, end double, close boolean, persons boolean, emotion boolean, micro boolean, hit boolean")
    clips = [(k, 21.25) for k in range(12)]
    of = lambda k: [s[1:] for s in segments if s[0] == k]
    for many in (3, 20, 1000):
        got = intervals.best_windows(spark.createDataFrame(clips, "key long, duration double"), rows, "key", [3, 12], many=many).collect()
        assert sorted(map(tuple, got)) == sorted((k, *w) for k, d in clips for w in _windows(d, of(k), [3, 12])), many
        got = intervals.best_windows(None, rows, "key", [3, 12], many=many).collect()
        assert sorted(map(tuple, got)) == sorted((k, *w) for k in range(1, 12) for w in _windows(max(s[1] for s in of(k)), of(k), [3, 12])), many


def test_segments_of_a_key_are_dealt_once(spark):
    """What tasks exchange are the segments, not eight places of each."""
    rows = spark.createDataFrame([(k, 0.0, 4.0, True, False, False, True, True) for k in range(50)], "key long, start double, end double, close boolean, persons boolean, emotion boolean, micro boolean, hit boolean")
    plan = intervals.best_windows(None, rows, "key", [3, 5, 8, 10])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def _plain_beats(words, least, most, cap):
    groups, now = [], []
    for w in words:
        now.append(w)
        lasts = now[-1][2] - now[0][1]
        if (w[0][-1:] in ".!?…" and lasts >= least * 0.6) or lasts >= most:
            groups.append(now)
            now = []
    groups += [now] if now else []
    while len(groups) > cap and len(groups) > 1:
        lasts = [g[-1][2] - g[0][1] for g in groups[:-1]]
        k = lasts.index(min(lasts))
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    out, at = [], 0
    for k, g in enumerate(groups, 1):
        out.append((k, at + 1, at + len(g), max(least, min(most, g[-1][2] - g[0][1]))))
        at += len(g)
    return out


@pytest.mark.parametrize("cap", [1, 3, 24])
def test_beats_equal_plain_merging(spark, cap):
    """Pauses, words that last no time, no words and null, and a text of 4,000 words."""
    draw, texts = random.Random(cap), {0: [], 1: None}
    for i in range(2, 40):
        at, words = 0, []
        for _ in range(4000 if i == 2 else draw.randrange(1, 200)):
            at += draw.choice([0, 0, 3, 30])
            words.append((draw.choice(["a", "and", "stop.", "what?", "so…"]), at, at + draw.randrange(0, 9)))
            at = words[-1][2]
        texts[i] = words
    df = spark.createDataFrame(list(texts.items()), "id int, words array<struct<word string, start long, end long>>")
    got = {}
    for r in directing.spoken_beats(df, "id", "words", 20, 60, cap).collect():
        got.setdefault(r["id"], []).append((r["beat"], r["first"], r["last"], r["hold"]))
    for i, words in texts.items():
        assert sorted(got.get(i, [])) == _plain_beats(words or [], 20, 60, cap), i
