"""Operator 9: surrogates for personal data. DataFrame and SQL functions only.

A pattern finds e-mail addresses, IPv4 addresses, IBANs (checked modulo 97), payment cards (Luhn), US social security
numbers, telephone numbers, and names (after a title, or a known given name before a capitalised one; then the surname
alone as well, wherever it stands in the text). Every mention is
made of entities: an address of its mailbox and its domain, a name of its given names (with the gender that title or
name tell) and its surname, anything else of itself, in a form that doesn't depend on punctuation or case. An entity's
surrogate is drawn by HMAC-SHA-512 under a key, which is the session's setting ``SETTING`` or else drawn at random once a session, from its kind and the entity: digits for digits and letters for letters, valid
checksums, brand and country kept, names of the same gender and script. It is written back in each mention's own format,
so that the same entity reads alike wherever it is met.

Collision checks: over the distinct entities of all texts, no two may share a surrogate and none may get one that is itself
an entity. Those that lose draw again (``attempt``) until all differ; letters grow longer with further draws.
Nearly all entities stay at draw 0, so that their surrogates are worked out in place; only texts that hold one of the
others are joined with these draws. A hot entity costs one row in the entity table, since rows are combined before the shuffle.

Defined cases: a null text stays null, without entities; empty texts stay empty; texts without entities stay as they are; repeated rows
are each rewritten alike; an empty table gives no rows; extra columns, whatever their names, are ignored by the query and kept by the
stage; a null doc_id is kept. Names without a title or a known given name are not found.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, written

#: The session setting that holds the key.
SETTING, ROUNDS = "spark.tessera.pii.key", 64
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "name")

# fixed values: titles by gender, and common given names by gender
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Г-н", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Г-жа", "Госпожа", "Κυρία"),
    "u": ("Dr", "Prof", "Professor", "Доктор"),
}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul",
          "Steven", "Andrew", "George", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Jacques", "François", "Michel", "José", "Juan", "Carlos",
          "Miguel", "Antonio", "Javier", "Иван", "Сергей", "Алексей", "Дмитрий", "Владимир", "Γιώργος", "Νίκος"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Lisa", "Emily", "Anna",
          "Maria", "Emma", "Laura", "Sabine", "Monika", "Ursula", "Petra", "Claudia", "Marie", "Sophie", "Camille", "Isabelle", "Nathalie", "Carmen", "Lucía",
          "Pilar", "Dolores", "Анна", "Мария", "Елена", "Ольга", "Татьяна", "Μαρία", "Ελένη"),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words in capitals that no name goes on with.
_NO_PART = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "I He She It We You They The This That These Those And But Or If As At In On By For From To With When Where While After Before Then There Here His Her Its Our Their My No Not Yes"
).split()
#: A part of a name: apostrophes and hyphens only between letters, and not before the "s" of a possessive.
_CAP = r"\p{Lu}(?:\p{L}|['\u2019-](?=\p{L})(?!s(?!\p{L}))){1,40}"
_NEXT = rf"(?!(?:{'|'.join(_NO_PART)})(?!\p{{L}})){_CAP}"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAME = "|".join(n for g in GIVEN.values() for n in g)
#: Every alternative begins where no letter or digit stands before, so that a run of them is tried once.
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join((
    r"(?<![._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    rf"(?<![0-9]\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
    r"\([0-9]{3}\)\x20?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9])",
    rf"(?:{_TITLE})\.?\x20{_CAP}(?:\x20{_NEXT}){{0,2}}(?!\p{{L}})",
    rf"(?:{_NAME})(?:\x20{_NEXT}){{1,2}}(?!\p{{L}})",
)) + ")"

# letters that surrogate names are made of, by script: consonants, vowels, feminine ending
SCRIPTS = {"latin": ("bdfgklmnprstv", "aeiou", "a"), "cyrillic": ("бвгдклмнпрст", "аеиоу", "а"), "greek": ("βγδκλμνπρτ", "αεηιο", "α")}
_GROW = 4  # draws after which letters grow longer


def kind_of(m: Column) -> Column:
    """The kind of a mention, by its own text; null for numbers whose checksum fails."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), F.when((F.length(m) >= 15) & (mod97(iban_turned(iban_of(m))) == 1), "iban"))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^([+(]|[0-9]{3}[.-])"), "phone")
        .when(m.rlike(r"^[0-9]"), F.when(F.call_function("luhn_check", digits), "card"))
        .otherwise("name")
    )


def iban_of(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def iban_turned(iban: Column) -> Column:
    return F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))


def mod97(text: Column) -> Column:
    """A number modulo 97, letters standing for 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def name_parts(m: Column) -> Column:
    return F.split(F.regexp_replace(m, rf"^(?:{_TITLE})\.?\x20", ""), " ")


def gender(m: Column) -> Column:
    """m, f or u, by title, then by the given name."""
    by_title = F.when(m.rlike(rf"^(?:{'|'.join(TITLES['m'])})\b"), "m").when(m.rlike(rf"^(?:{'|'.join(TITLES['f'])})\b"), "f")
    first = name_parts(m)[0]
    return F.coalesce(by_title, F.when(first.isin(*GIVEN["m"]), "m").when(first.isin(*GIVEN["f"]), "f"), F.lit("u"))


def part_entity(m: Column, parts: Column, i: Column) -> Column:
    """Of a name's parts the last is the surname."""
    return entity(F.when(i == F.size(parts) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender(m))), F.lower(parts[i]))


def entity(kind: Column, canon: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"))


def number_of(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(kind == "iban", iban_of(m)).when(kind == "phone", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10))).otherwise(digits)


def entities_of(m: Column, kind: Column) -> Column:
    """The entities of a mention, as an array."""
    parts = name_parts(m)
    domain = F.lower(F.substring_index(m, "@", -1))
    return (
        F.when(kind == "email", F.array(entity(F.lit("email"), F.lower(m)), entity(F.lit("domain"), domain)))
        .when(kind == "name", F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: part_entity(m, parts, i)))
        .when(kind == "ip", F.array(entity(kind, m)))
        .otherwise(F.array(entity(kind, number_of(kind, m))))
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting; where there is none, a random one, which then is the session's."""
    key = spark.conf.get(SETTING, None)
    if not key:
        spark.conf.set(SETTING, key := secrets.token_hex(32))
    return key


def hmac(key: str, text: Column) -> Column:
    """HMAC-SHA-512 of a text, as hexadecimal digits."""
    block = hashlib.sha512(key.encode()).digest().ljust(128, b"\0")  # keys of any length are hashed first
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 512))), 512)


class Draw:
    """Keyed numbers for an entity's draw, from 256 hexadecimal digits: ``at(i)`` is below 256."""

    def __init__(self, hex: Column):
        self.hex = hex

    @staticmethod
    def digits(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
        seed = F.concat_ws("\x1f", kind, canon, attempt.cast("string"))
        return F.concat(hmac(key, seed), hmac(key, F.concat(seed, F.lit("\x1f+"))))

    def at(self, i) -> Column:
        place = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(128))
        return F.conv(F.substring(self.hex, place * 2 + 1, F.lit(2)), 16, 10).cast("int")


LOWER, DIGITS, UPPER = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def like(draw: Draw, text: Column) -> Column:
    """A text of the same format: digits for digits, letters for letters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        letters = F.when(c.rlike("[0-9]"), DIGITS).when(c.rlike("[a-z]"), LOWER).when(c.rlike("[A-Z]"), UPPER).otherwise(c)
        return F.substring(letters, draw.at(i) % F.length(letters) + 1, F.lit(1))

    return F.array_join(F.transform(chars, one), "")


def grown(draw: Draw, attempt: Column) -> Column:
    """Further letters after ``_GROW`` draws, so that no format runs out of surrogates."""
    extra = F.greatest(attempt - _GROW + 1, F.lit(0))
    return F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: F.substring(F.lit(LOWER), draw.at(i + 100) % 26 + 1, F.lit(1))), "")).otherwise("")


def luhn_digit(body: Column) -> Column:
    chars = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    twice = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(twice, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def name_surrogate(draw: Draw, kind: Column, canon: Column, attempt: Column) -> Column:
    def of_script(k: int) -> Column:
        return F.when(canon.rlike(r"\p{IsCyrillic}"), SCRIPTS["cyrillic"][k]).when(canon.rlike(r"\p{IsGreek}"), SCRIPTS["greek"][k]).otherwise(SCRIPTS["latin"][k])

    def pick(i, letters: Column) -> Column:
        return F.substring(letters, draw.at(i) % F.length(letters) + 1, F.lit(1))

    def made(letters: Column) -> Column:
        syllables = 2 + draw.at(0) % 2 + attempt
        body = F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: F.concat(pick(i * 2, letters["c"]), pick(i * 2 + 1, letters["v"]))), "")
        return F.concat(body, pick(90, letters["c"]), F.when(kind == "given_f", letters["f"]).otherwise(""))

    return let(F.struct(*(of_script(k).alias(n) for k, n in enumerate("cvf"))), made)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity at a draw, in the entity's plain form; of an address only the mailbox differs here."""
    return let(Draw.digits(key, kind, canon, attempt), lambda h: drawn(Draw(h), kind, canon, attempt))


def drawn(draw: Draw, kind: Column, canon: Column, attempt: Column) -> Column:
    # what of the entity is drawn: of a mailbox all, of a domain all but its last label, of a number all but what it keeps
    top = F.substring_index(canon, ".", -1)
    free = (
        F.when(kind == "email", F.substring_index(canon, "@", 1))
        .when(kind == "domain", F.substring(canon, F.lit(1), F.length(canon) - F.length(top) - 1))
        .when(kind == "iban", F.substring(canon, 5, 40))
        .when(kind == "card", F.substring(canon, F.lit(2), F.length(canon) - 2))
        .otherwise(F.substring(canon, 2, 20))
    )

    def finished(new: Column) -> Column:
        country, card = F.substring(canon, 1, 2), F.concat(F.substring(canon, 1, 1), new)
        check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        return (
            F.when(kind == "email", F.concat(new, grown(draw, attempt), F.lit("@"), F.substring_index(canon, "@", -1)))
            .when(kind == "domain", F.concat(new, grown(draw, attempt), F.lit("."), top))
            .when(kind == "iban", F.concat(country, check, new))
            .when(kind == "card", F.concat(card, luhn_digit(card)))
            .otherwise(F.concat((draw.at(127) % 8 + 2).cast("string"), new))
        )

    return (
        F.when(kind.isin("surname", "given_m", "given_f", "given_u"), name_surrogate(draw, kind, canon, attempt))
        .when(kind == "ip", F.concat_ws(".", *[(draw.at(i) % 254 + 1).cast("string") for i in range(4)]))
        .otherwise(let(like(draw, free), finished))
    )


def in_format(m: Column, plain: Column) -> Column:
    """A number in the mention's format: its last letters and digits replaced in order, all else kept (as a country's prefix)."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    lead = F.length(F.regexp_replace(m, "[^A-Za-z0-9]", "")) - F.length(plain)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(a, c):
        new = F.when(a["i"] < lead, c).otherwise(F.substring(plain, a["i"] - lead + 1, F.lit(1)))
        put = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(a["out"], F.when(put, new).otherwise(c)).alias("out"), (a["i"] + put.cast("int")).alias("i"))

    return F.aggregate(chars, start, step, lambda a: a["out"])


def cased(new: Column, old: Column) -> Column:
    return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).when(F.substring(old, 1, 1) == F.upper(F.substring(old, 1, 1)), F.initcap(new)).otherwise(new)


def rendered(key: str, m: Column, kind: Column, draws: Column | None) -> Column:
    """What stands for a mention. ``draws``: attempts by "kind:canon" where they aren't 0."""

    def plain(e: Column) -> Column:
        attempt = F.lit(0) if draws is None else F.coalesce(F.try_element_at(draws, F.concat_ws(":", e["kind"], e["canon"])), F.lit(0))
        return surrogate(key, e["kind"], e["canon"], attempt)

    def put(new: Column) -> Column:
        email = F.concat(F.substring_index(new[0], "@", 1), F.lit("@"), F.get(new, F.lit(1)))
        title = F.regexp_extract(m, rf"^((?:{_TITLE})\.?\x20)", 1)
        name = F.concat(title, F.array_join(F.zip_with(new, name_parts(m), cased), " "))
        return (
            F.when(kind == "email", F.when(m == F.upper(m), F.upper(email)).otherwise(email))
            .when(kind == "name", name)
            .when(kind == "ip", new[0])
            .otherwise(in_format(m, new[0]))
        )

    return F.when(kind.isNull(), m).otherwise(let(F.transform(entities_of(m, kind), plain), put))


def with_mentions(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the mentions of their texts in a column ``name`` (m, and its kind; null where a checksum fails), in order, and in
    ``name_pattern`` the pattern where it isn't the plain one: with the surnames of a text's names, so that these are met where they
    stand alone as well. Only such texts are matched again."""
    text, plain, pattern = F.coalesce("text", F.lit("")), F.col(f"{name}_plain"), F.col(f"{name}_pattern")
    rows = rows.withColumn(f"{name}_plain", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    names = F.filter(plain, lambda m: m.rlike(r"^\p{Lu}") & ~m.contains("@") & ~m.rlike("^[A-Z]{2}[0-9]{2}"))
    surnames = F.array_join(F.array_distinct(F.transform(names, lambda m: F.element_at(name_parts(m), -1))), "|")
    rows = rows.withColumn(f"{name}_pattern", F.nullif(surnames, F.lit("")))
    alone = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}@._-])(?:"), pattern, F.lit(r")(?![\p{L}\p{N}@_-])"))
    rows = rows.withColumn(f"{name}_pattern", F.when(pattern.isNotNull(), alone))
    found = F.when(pattern.isNull(), plain).otherwise(F.regexp_extract_all(text, pattern, F.lit(0)))
    return rows.withColumn(name, F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))).drop(f"{name}_plain")


def entity_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """kind and canon of every entity of every mention, a row each, beside the columns ``more``."""
    names = list(more)
    rows = with_mentions(docs.select("text", *(c.alias(n) for n, c in more.items())), "mentions")
    # outer, since explode alone has its input worked out once more for a filter on its size
    mentions = rows.select(*names, F.explode_outer("mentions").alias("f")).where("f.kind IS NOT NULL")
    return mentions.select(*names, F.explode_outer(entities_of(F.col("f.m"), F.col("f.kind"))).alias("e")).select(*names, "e.kind", "e.canon")


def redraws(docs: DataFrame, key: str) -> DataFrame | None:
    """kind, canon, attempt of the entities that may not keep draw 0; None if all may."""
    draw = lambda attempt: surrogate(key, F.col("kind"), F.col("canon"), attempt).alias("sur")
    base = written(entity_rows(docs).distinct().select("kind", "canon", draw(F.lit(0))), "pii-entities")
    real = base.select("kind", F.col("canon").alias("sur"))

    def losers(rows: DataFrame, *taken: DataFrame) -> DataFrame:
        first = rows.groupBy("kind", "sur").agg(F.min("canon").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        lost = [rows.join(first, ["kind", "sur"]).where("canon <> first").select("kind", "canon")]
        lost += [rows.join(t, ["kind", "sur"], "left_semi").select("kind", "canon") for t in taken]
        return reduce(DataFrame.union, lost).distinct()

    lost, kept, attempt, still = written(losers(base, real), "pii-lost"), None, 0, 0
    while not lost.isEmpty():
        attempt += 1
        rows = written(lost.select("kind", "canon", F.lit(attempt).alias("attempt"), draw(F.lit(attempt))), "pii-draws")
        earlier = [base.select("kind", "sur"), real] + ([kept.select("kind", "sur")] if kept is not None else [])
        lost = written(losers(rows, *earlier), "pii-lost")
        settled = written(rows.join(lost, ["kind", "canon"], "left_anti"), "pii-settled")
        still = still + 1 if settled.isEmpty() else 0
        if still == ROUNDS:
            raise ValueError(f"no surrogate was free in {ROUNDS} draws: a fixed format has hardly more values than the texts have entities")
        kept = settled if kept is None else kept.unionByName(settled)
    return kept


def with_surrogates(docs: DataFrame, key: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with ``text`` rewritten and the mentions that were met, in a column of the name that is returned (one that
    ``docs`` hasn't). ``key``: by default that of the session."""
    key, own = key or session_key(docs.sparkSession), "mentions"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    found, pattern, hash_, drawn = own, f"{own}_pattern", f"{own}_hash", f"{own}_draws"
    again = redraws(docs, key)
    rows = docs
    if again is not None:  # draws by text, so that rows meet theirs whatever their id; equal texts share a row of them
        held = entity_rows(docs, _h=F.xxhash64("text")).distinct()
        by_text = held.join(again, ["kind", "canon"]).groupBy(F.col("_h").alias(hash_)).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "canon"), "attempt"))).alias(drawn))
        rows = docs.withColumn(hash_, F.xxhash64("text")).join(written(by_text, "pii-by-text"), hash_, "left")
    draws = None if again is None else F.col(drawn)
    rows = with_mentions(rows, own)
    parts = F.split(F.col("text"), F.coalesce(pattern, F.lit(PATTERN)), -1)
    new = F.transform(F.col(found), lambda f: rendered(key, f["m"], f["kind"], draws))
    whole = F.array_join(F.zip_with(parts, new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return rows.withColumn("text", F.when(F.size(found) == 0, F.col("text")).otherwise(whole)).drop(hash_, drawn, pattern), found


def surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with surrogates, and the number of mentions in all and by kind."""
    rows, found = with_surrogates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    rows = rows.withColumn("kinds", F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull()))
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", kind))).alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", "text", F.size("kinds").alias("n_found"), *counts)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(documents(spark, sf_dir))


def hide(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its text with surrogates and its length counted anew, with its columns."""
    rows, found = with_surrogates(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(found) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
