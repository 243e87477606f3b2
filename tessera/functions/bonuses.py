"""What a clip's stored metadata add to its score for a beat: sixteen terms, each with a bound of its own, as column expressions.

A clip without an annotation for a term (null, or an empty list) gets 0 for it. Texts are compared in lower case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a beat's text, what a clip must show for them, and the points.
MOVEMENTS = [
    (r"enters?\s*(frame|beeld|shot)|komt\s*in\s*beeld", ["enters frame left", "enters frame right", "enters frame bottom", "enters frame"], 2),
    (r"exits?\s*(frame|beeld)|verdwijnt\s*uit\s*beeld", ["exits frame left", "exits frame right", "exits frame"], 2),
    (r"(approaches|towards|toward|naar camera|nadert)", ["approaches camera", "towards camera"], 2),
    (r"(moves?\s*away|retreats?|weg van camera)", ["away from camera"], 2),
    (r"left.{0,8}right|van links|links.{0,8}rechts", ["left→right"], 2),
    (r"right.{0,8}left|van rechts|rechts.{0,8}links", ["right→left"], 2),
    (r"(stationary|staat stil|beweegt niet|still)", ["stationary"], 2),
    (r"(crosses?\s*frame|doorsteekt\s*beeld)", ["crosses frame"], 2),
]
SOUNDS = [
    (r"\b(crowd|menigte|publiek|massa)\b", ["crowd"], 3),
    (r"\b(speech|toespraak|address|redevoering)\b", ["speech"], 3),
    (r"\b(applaus|applause|cheering|gejuich)\b", ["applause", "crowd"], 3),
    (r"\b(explosion|explosie|blast|bomb)\b", ["loud event"], 4),
    (r"\b(music|muziek|anthem|hymn)\b", ["music"], 3),
    (r"\b(silence|stilte|quiet|rustig)\b", ["silence"], 2),
    (r"\b(gunfire|shots|schoten|shooting)\b", ["loud event"], 3),
    (r"\b(engines?|motors?|aircraft|vliegtuig)\b", ["engines", "loud event"], 2),
    (r"\b(radio|broadcast|uitzending)\b", ["radio", "speech"], 2),
    (r"\b(march|marching|drums?)\b", ["music", "march"], 2),
]
PICTURES = [
    (r"\b(aerial|drone|bird.?s eye|vanuit de lucht|luchtopname)\b", ["aerial view", "aerial", "drone"], 1),
    (r"\b(skyline|horizon|panorama|stadsaanzicht)\b", ["skyline", "landscape"], 1),
    (r"\b(crowd|massa|menigte|protest)\b", ["crowd shot", "crowd"], 1),
    (r"\b(establishing|opening|introductie|overzicht)\b", ["establishing shot", "aerial view"], 1),
    (r"\b(interview|conversation|gesprek|talking head)\b", ["interview", "portrait"], 1),
    (r"\b(reaction|reactie|response)\b", ["reaction shot", "insert shot"], 1),
    (r"\b(destruction|ruin|vernieling|ruins?)\b", ["destruction", "ruins", "aftermath"], 1),
    (r"\b(fire|flame|vuur|brand)\b", ["fire", "destruction"], 1),
    (r"\b(smoke|rook|mist)\b", ["smoke"], 1),
    (r"\b(celebration|overwinning|feest|victory)\b", ["celebration"], 1),
    (r"\b(ceremony|plechtigheid|parade)\b", ["ceremony", "procession"], 1),
    (r"\b(silhouette|schaduw|backlit)\b", ["silhouette"], 1),
    (r"\b(battle|gevecht|combat|fight)\b", ["battle", "action"], 1),
    (r"\b(archive|historical|archief|oud materiaal)\b", ["archive footage", "newsreel"], 1),
    (r"\b(insert|detail|close.?up|close shot)\b", ["insert shot", "close detail"], 1),
    (r"\b(b.?roll|context shot|sfeer)\b", ["b-roll", "cutaway"], 1),
    (r"\b(symmetr|balanced|centraal)\b", ["symmetry", "leading lines"], 1),
]
STORIES = [
    (r"\b(establishing|overzicht|overview|introductie)\b", ["establishing", "context"], 2),
    (r"\b(action|gevecht|battle|fighting|aanval)\b", ["action", "climax"], 2),
    (r"\b(reaction|reactie|response|respons)\b", ["reaction", "emotion"], 2),
    (r"\b(reveal|onthulling|ontdekking|discovery)\b", ["reveal"], 2),
    (r"\b(climax|hoogtepunt|decisive|beslissend)\b", ["climax"], 2),
    (r"\b(transition|overgang|change|shift)\b", ["transition"], 2),
    (r"\b(emotion|emotie|feeling|gevoel|sad|verdriet)\b", ["emotion", "reaction"], 2),
    (r"\b(detail|close.?up|insert)\b", ["detail"], 2),
    (r"\b(ending|einde|conclusion|aftermath)\b", ["ending", "context"], 2),
]


def _whole(x: Column) -> Column:
    """Rounded, halves up."""
    return F.floor(x + 0.5)


def _bounded(x: Column, low: int, high: int) -> Column:
    """x within the bounds; null is 0 (least and greatest pass over nulls)."""
    return F.when(x.isNull(), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x.cast("long"))))


def _count(xs: Column, test) -> Column:
    return F.coalesce(F.size(F.filter(xs, lambda x: F.coalesce(test(x), F.lit(False)))), F.lit(0))


def _steps(x: Column, steps: list[tuple[int, int]]) -> Column:
    """The points of the first limit that x reaches, 0 where none (or x is null)."""
    out = F.when(x >= steps[0][0], steps[0][1])
    for limit, points in steps[1:]:
        out = out.when(x >= limit, points)
    return out.otherwise(0)


def told(text: Column, tags: Column, rules: list, same: bool = False) -> Column:
    """The points of the rules whose pattern the text has, and of whose words a tag holds one (or, if ``same``, is one)."""
    def shown(wanted):
        return F.exists(tags, (lambda t: t.isin(wanted)) if same else (lambda t: reduce(Column.__or__, (F.contains(t, F.lit(w)) for w in wanted))))

    return reduce(Column.__add__, (F.when(text.rlike(f"(?i){pattern}") & shown(wanted), points).otherwise(0) for pattern, wanted, points in rules))


def expected(tags: Column, asked: Column, points: int) -> Column:
    """Points for each of what is asked that a tag holds."""
    return points * _count(asked, lambda a: F.exists(tags, lambda t: F.contains(t, F.lower(a))))


def segment(similarities: Column, clip: Column) -> Column:
    """How much nearer than the whole clip (0.5 where unknown) the first segment is: 1 for each 0.025 above 0.02."""
    gain = F.get(similarities, F.lit(0)) - F.coalesce(clip, F.lit(0.5))
    return _bounded(F.when(gain > 0.02, _whole(gain / 0.025)), 0, 6)


def faces(entity: Column, tracks: Column) -> Column:
    """Presence, share, closeness and rank of the first track (name, share, close, main) of the wanted person; of the main one if none
    is wanted."""
    tokens = F.filter(F.split(F.lower(entity), r"\s+"), lambda t: F.length(t) > 2)
    main = F.get(F.filter(tracks, lambda f: f["main"]), F.lit(0))
    found = F.get(F.filter(tracks, lambda f: F.exists(tokens, lambda t: F.contains(F.lower(f["name"]), t))), F.lit(0))
    points = 2 + F.when(found["share"] > 0.6, 4).when(found["share"] > 0.3, 2).otherwise(0) + F.when(found["close"] >= 2, 2).otherwise(0) + F.when(found["main"], 1).otherwise(0)
    alone = F.when((main["share"] >= 0.5) & (main["close"] >= 2), 3)
    return _bounded(F.when(F.coalesce(entity, F.lit("")) == "", alone).when(found.isNotNull(), points), 0, 6)


def quality(overall: Column, block: Column) -> Column:
    """Of the overall figure, or else the mean of overall, sharpness and stability."""
    return _steps(F.coalesce(overall.cast("double"), _whole((block["overall"] + block["sharpness"] + block["stability"]) / 3).cast("double")), [(85, 3), (70, 2), (55, 1)])


def subject(name: Column, text: Column, intents: Column) -> Column:
    """The clip's subject in the text, or else some of its search intents."""
    first = F.get(F.split(text, " "), F.lit(0))
    n = _count(intents, lambda t: (F.length(t) > 4) & (F.contains(text, F.lower(t)) | F.contains(F.lower(t), first)))
    return F.when(F.coalesce(name, F.lit("")) == "", 0).when(F.contains(text, F.lower(name)), 6).otherwise(_steps(n, [(3, 4), (1, 2)]))


def priority(topics: Column, text: Column) -> Column:
    """The best of the topics (topic, score) by the share of its words in the text."""
    words = lambda e: F.filter(F.split(F.lower(e["topic"]), r"\s+"), lambda t: F.length(t) > 3)
    worth = lambda e: _whole(_count(words(e), lambda t: F.contains(text, t)) / F.greatest(F.lit(1), F.size(words(e))) * (e["score"] / 100) * 4)
    return _bounded(F.array_max(F.transform(topics, worth)), 0, 4)


def negative(tags: Column, text: Column) -> Column:
    """3 less for each tag ("NOT ..." or without) in the text, 5 at most."""
    term = lambda t: F.lower(F.trim(F.regexp_replace(t, r"(?i)^NOT\s+", "")))
    return F.greatest(F.lit(-5), -3 * _count(tags, lambda t: (F.length(term(t)) >= 3) & F.contains(text, term(t))))


def capability(scores: Column, required: Column, unwanted: Column) -> tuple[Column, Column]:
    """Bonus and penalty of what a clip can do (a map of scores, 0 where missing) for what the beat needs and what spoils it. Nothing where
    the beat needs nothing."""
    of = lambda c: F.coalesce(F.try_element_at(scores, c), F.lit(0))
    total = lambda xs, worth: F.aggregate(xs, F.lit(0), lambda a, c: a + worth(of(c)))
    strength = lambda s: _steps(s, [(80, 3), (60, 2), (40, 1)])
    asked = scores.isNotNull() & (F.size(required) > 0)
    lacking = total(required, lambda s: F.when(s < 20, 1).otherwise(0)) + total(F.coalesce(unwanted, F.array().cast("array<string>")), strength)
    return F.when(asked, F.least(F.lit(8), total(required, strength))).otherwise(0), F.when(asked, -F.least(F.lit(6), lacking)).otherwise(0)


def temporal(windows: Column, duration: Column, beat: Column, highlights: Column) -> Column:
    """The best of the windows (duration, score) at most 1.5 seconds longer than the beat, unless the beat takes the whole clip; without a
    beat's length 1 for any highlight."""
    fitting = F.filter(windows, lambda w: w["duration"] <= beat + 1.5)
    best = F.array_max(F.transform(fitting, lambda w: w["score"]))
    return F.when(beat > 0, F.when(beat < duration, F.coalesce(_whole(best / 100 * 5), F.lit(0))).otherwise(0)).when(F.size(highlights) > 0, 1).otherwise(0)


def metadata(clip, beat) -> dict[str, Column]:
    """The sixteen terms by name. ``clip`` and ``beat`` give columns by name (as ``lambda name: F.col(name)`` does)."""
    text = F.lower(F.coalesce(beat("text"), F.lit("")))
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    moves = F.transform(clip("objects"), lambda o: F.lower(F.concat_ws("\n", o["movement"], o["direction"])))
    sounds, pictures = low(clip("sounds")), low(clip("pictures"))
    bonus, penalty = capability(clip("capabilities"), beat("required"), beat("unwanted"))
    return {
        "segment": segment(clip("segments"), clip("similarity")),
        "face": faces(beat("entity"), clip("faces")),
        "object": _bounded(told(text, moves, MOVEMENTS), 0, 4),
        "audio": _bounded(F.when(sounds.isNotNull(), expected(sounds, beat("sounds"), 3) + told(text, sounds, SOUNDS)), 0, 5),
        "cinematic": _bounded(F.when(pictures.isNotNull(), expected(pictures, beat("pictures"), 2) + told(text, pictures, PICTURES)), 0, 6),
        "importance": _bounded(_whole((clip("importance") - 50) / 10), 0, 5),
        "uniqueness": _bounded(_whole((clip("uniqueness") - 50) / 17), 0, 3),
        "storytelling": _bounded(told(text, clip("stories"), STORIES, True), 0, 4),
        "quality": quality(clip("quality"), clip("block")),
        "health": _steps(clip("health"), [(80, 2), (60, 1)]),
        "subject": subject(clip("subject"), text, clip("intents")),
        "priority": priority(clip("topics"), text),
        "negative": negative(clip("negative"), text),
        "capability": bonus,
        "incapability": penalty,
        "temporal": temporal(clip("windows"), clip("duration"), beat("duration"), clip("highlights")),
    }
