"""Column expressions on words: units (grapheme clusters), keys, hashes, distances and marks. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A unit is a code point and the dependent signs of the Tamil block that follow it.
SIGNS = "ஂா-்ௗ"
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def tokens(text: Column, pattern: str = "[a-z]+") -> Column:
    """The words of a text, A-Z lower-cased by Spark's lower()."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), 1)


def units(word: Column) -> Column:
    """Grapheme clusters; a sign at the start is a unit of its own."""
    return F.regexp_extract_all(word, F.lit(f"(?s)(.[{SIGNS}]*)"), 1)


def unit_kind(unit: Column) -> Column:
    """uyir, aytham, mei, uyirmei or other, by the base's range and the pulli."""
    consonant = unit.rlike("^[க-ஹ]")
    return (
        F.when(unit.rlike("^[அ-ஔ]"), "uyir")
        .when(unit.rlike("^ஃ"), "aytham")
        .when(consonant & unit.rlike("்") & ~unit.rlike("[ா-ௌௗ]"), "mei")
        .when(consonant, "uyirmei")
        .otherwise("other")
    )


def multiset_key(parts: Column) -> Column:
    return F.array_join(F.array_sort(parts), "\u001f")


def first_letter_hex(word: Column) -> Column:
    """The first code point as four lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.encode(F.substring(word, 1, 1), "UTF-16BE")), 4, "0"))


def deletions(word: Column) -> Column:
    """The word and what is left of it after taking away one or two characters, without repeats."""

    def one(x: Column) -> Column:
        shorter = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
        return F.when(F.length(x) > 0, shorter).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(word), one(word), F.flatten(F.transform(one(word), one))))


def bounded_distance(left: Column, right: Column, most: int) -> Column:
    """Edit distance, most + 1 where it is greater."""
    found = F.levenshtein(left, right, most)
    return F.when(found < 0, most + 1).otherwise(found)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units."""
    code_units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1), lambda u: F.conv(u, 16, 10).cast("long"))
    step = lambda state, u: (state.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(MASK)
    return F.aggregate(code_units, F.lit(FNV_START).cast("long"), step)


def _times32(a: Column, b: Column) -> Column:
    return (a * b.bitwiseAND(65535) + (a * F.shiftright(b, 16)).bitwiseAND(65535) * 65536).bitwiseAND(MASK)


def mulberry(seed: Column, draw: int | Column = 1) -> Column:
    """The float in [0, 1) that the 32-bit generator mulberry32 gives at the draw-th call. Its step and shifts are fixed values."""
    a = (seed + draw * F.lit(0x6D2B79F5).cast("long")).bitwiseAND(MASK)
    t = _times32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    u = t.bitwiseXOR((t + _times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(MASK))
    return u.bitwiseXOR(F.shiftright(u, 14)) / 4294967296.0


def seeded_index(count: Column, seed_text: Column) -> Column:
    """One of `count` places from a text: its hash seeds the generator, which mixes it. No place among none or fewer is an error."""
    place = F.least(F.floor(mulberry(fnv1a(seed_text)) * count), count - 1)
    return F.when(count > 0, place).otherwise(F.raise_error(F.lit("count must be positive")).cast("long"))


def marks(guess: Column, answer: Column) -> Column:
    """For each place of the guess correct, present or absent, each letter of the answer serving once."""
    places = F.sequence(F.lit(1), F.length(guess))
    at = lambda w, i: F.substr(w, i, F.lit(1))
    open_answer = F.filter(F.sequence(F.lit(1), F.length(answer)), lambda i: at(guess, i) != at(answer, i))
    open_guess = F.filter(places, lambda i: at(guess, i) != at(answer, i))

    def mark(i: Column) -> Column:
        supply = F.size(F.filter(open_answer, lambda k: at(answer, k) == at(guess, i)))
        before = F.size(F.filter(open_guess, lambda k: (k < i) & (at(guess, k) == at(guess, i))))
        return F.when(at(guess, i) == at(answer, i), "correct").when(supply > before, "present").otherwise("absent")

    return F.transform(places, mark)
