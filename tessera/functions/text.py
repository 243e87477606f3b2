"""Text keys: normalised keys, slugs and keyword sets."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as scripts of the web know it, the same for every engine (their ``\\s`` differ).
BLANKS = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_LATIN = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
#: Latin letters that decompose into an ASCII letter and marks, in lower case, and these letters.
MARKED = "".join(c for c in map(chr, _LATIN) if c == c.lower() and len(d := normalize("NFD", c)) > 1 and d[0].isascii())
BARE = "".join(normalize("NFD", c)[0] for c in MARKED)


def key(text: Column, most: int = 256) -> Column:
    """Lower case, trimmed, runs of white space as one blank, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), BLANKS, " ")), 1, most)


def slug(text: Column, most: int = 100) -> Column:
    """Lower-case ASCII letters and digits, anything else as single hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def keywords(text: Column, least: int = 4) -> Column:
    """The distinct lower-case words of at least ``least`` characters, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) >= least))


def canonical_url(url: Column) -> Column:
    """Lower case, without the query string."""
    return F.lower(F.split_part(url, F.lit("?"), F.lit(1)))


#: Words in capitals that are no names.
NO_NAMES = (
    "THE AND FOR FROM THIS THAT WITH INTO BBC CNN NBC CBS SKY ITV PBS NEWS LIVE BREAKING ALERT FLASH UPDATE "
    "PART CLIP VIDEO FILE TAPE UNITED STATES NATIONS KINGDOM REPUBLIC PRESS PHOTO AGENCY WIRE"
).split()
#: The patterns of entities in texts read off pictures. Blanks are ASCII ones and lines end with \\n.
_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
_S = r"[\x09-\x0D ]"
YEARS = r"\b(1[5-9][0-9][0-9]|20[0-9][0-9])\b"
DATES = rf"(?i)\b((?:{_MONTHS})[.,]?{_S}+[0-9]{{1,2}}[,.]?{_S}+[0-9]{{4}})\b"
NUMBER_DATES = r"\b([0-9]{1,2}[\x09-\x0D ./][0-9]{1,2}[\x09-\x0D ./][0-9]{4})\b"
PLACES = rf"\b(?:IN|AT|NEAR|OUTSIDE|FROM|REPORTED FROM|REPORTING FROM|LIVE FROM){_S}+([A-Z][A-Za-z\x09-\x0D ,]{{3,35}}?)(?:[.,:\n]|\z)"
NAMES = rf"\b([A-Z]{{2,}}{_S}+[A-Z]{{2,}})\b"
HEADLINES = r"(?:^|\n)([A-Z][A-Z\x09-\x0D :,'\"-]{10,80})(?:\n|\z)"
MOST_ENTITIES = 60


def calm(text: Column) -> Column:
    """The text with lines that end with \\n, ASCII blanks, and U+0001 for every other character than ASCII: what ``entities`` reads.
    So every engine sees the same word bounds."""
    lines = F.regexp_replace(text, "\\r\\n|[\\r\\x{2028}\\x{2029}]", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]", " "), r"[^\x00-\x7F]", "\x01")


def entities(plain: Column) -> Column:
    """Of a ``calm`` text up to 60 distinct entities as ``kind:text``, in the order of their kinds: years and dates, places after a
    preposition, pairs of words in capitals that are names, lines in capitals.

    Other characters than ASCII part words and are in no entity. A line in capitals that follows another one directly is part of that
    one's match or passed over with it.
    """
    every = lambda pattern: F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, rf"^{_S}+|{_S}+$", ""))
    tagged = lambda kind, found: F.transform(found, lambda x: F.concat(F.lit(kind + ":"), x))
    places = F.filter(every(PLACES), lambda x: (F.length(x) >= 3) & (F.length(x) <= 35))
    no = F.array(*map(F.lit, NO_NAMES))
    pairs = F.filter(F.transform(every(NAMES), lambda x: F.split(x, f"{_S}+")), lambda w: ~F.arrays_overlap(w, no) & (F.length(w[0]) <= 18) & (F.length(w[1]) <= 18))
    heads = F.filter(every(HEADLINES), lambda x: x.rlike("[A-Z]{4,}"))
    dates = F.concat(every(YEARS), every(DATES), every(NUMBER_DATES))
    found = F.concat(tagged("date", dates), tagged("location", places), tagged("person", F.transform(pairs, lambda w: F.concat_ws(" ", w))), tagged("headline", heads))
    return F.slice(F.array_distinct(found), 1, MOST_ENTITIES)


def duration(seconds: Column) -> Column:
    """Whole seconds as ``3m 05s``, under a minute as ``5s``."""
    s = seconds.cast("long")
    return F.when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def weighted_cosine(words: Column, weights: Column, query: dict[str, int]) -> Column:
    """The cosine of a bag of weighted words (parallel arrays) with the query's words; 0 where the bag is empty."""
    wanted = F.create_map(*(F.lit(x) for kv in query.items() for x in kv))
    bag = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), F.aggregate(F.filter(F.arrays_zip(words.alias("w"), weights.alias("x")), lambda e: e["w"] == w), F.lit(0), lambda a, e: a + e["x"]).alias("x")))
    dot = F.aggregate(bag, F.lit(0.0), lambda a, e: a + e["x"] * F.coalesce(F.try_element_at(wanted, e["w"]), F.lit(0)))
    norm = F.sqrt(F.aggregate(bag, F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
    return F.coalesce(F.try_divide(dot, norm * float(sum(v * v for v in query.values())) ** 0.5), F.lit(0.0))


def plain_slug(text: Column, default: str, most: int = 100) -> Column:
    """A slug of letters without diacritics (composed or as marks of their own); ``default`` where nothing is left."""
    return F.coalesce(F.nullif(slug(F.translate(F.regexp_replace(F.lower(text), r"[\x{300}-\x{36F}]", ""), MARKED, BARE), most), F.lit("")), F.lit(default))


def fragment(note: Column) -> Column:
    """A note "Fragment uit NAME (m:ss–m:ss)" as source (lower case), start and end in seconds; nulls where it isn't one, or ends
    before it starts."""
    part = lambda k: F.regexp_extract(note, r"^Fragment uit (.+?) \((\d+):(\d{2})[–-](\d+):(\d{2})\)$", k)
    number = lambda k: part(k).try_cast("long")
    start, end = number(2) * 60 + number(3), number(4) * 60 + number(5)
    ok = end > start
    return F.struct(F.when(ok, F.lower(F.trim(part(1)))).alias("source"), F.when(ok, start).alias("start"), F.when(ok, end).alias("end"))
