"""What Tamil allows of letters and words, as column expressions over grapheme clusters (see texts.units)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.texts import SIGNS, unit_kind, units

#: Fixed values of the script, in its own order: vowels, consonants by class, borrowed consonants, vowel signs, and the two characters apart.
VOWELS = "அஆஇஈஉஊஎஏஐஒஓஔ"
HARD, SOFT, MIDDLE = "கசடதபற", "ஙஞணநமன", "யரலவழள"
BORROWED = "ஜஶஷஸஹ"
VOWEL_SIGNS = "ாிீுூெேைொோௌ"
PULLI, AYTHAM = "்", "ஃ"
#: Consonants that may open a word, those that may close one, those that do not double, and those that any soft one may meet.
OPENING, CLOSING, SINGLE, AFTER_SOFT = "கசஙஞதநபமயவ", "மனணலளரழய", "ரழ", "மயவ"
#: ASCII labels of vowels (and of their signs), of consonants, and of the aytham.
VOWEL_LABELS = {"அ": "a", "ஆ": "aa", "இ": "i", "ஈ": "ii", "உ": "u", "ஊ": "uu", "எ": "e", "ஏ": "ee", "ஐ": "ai", "ஒ": "o", "ஓ": "oo", "ஔ": "au"}
CONSONANT_ROMAN = {
    "க": "k", "ங": "ng", "ச": "ch", "ஞ": "nj", "ட": "d", "ண": "N", "த": "th", "ந": "nh", "ப": "p", "ம": "m", "ய": "y", "ர": "r", "ல": "l", "வ": "v", "ழ": "zh", "ள": "L", "ற": "tr", "ன": "n",
    "ஜ": "j", "ஶ": "sh", "ஷ": "ss", "ஸ": "s", "ஹ": "h",
}
VOWEL_ROMAN = list(VOWEL_LABELS.values())
AYTHAM_ROMAN = "aytham"

CONSONANTS = HARD + SOFT + MIDDLE
#: A consonant with a pulli alone, and next to it a letter that it may not meet.
BAD_CLUSTER = "|".join(
    [f"[{HARD}]{PULLI}[^{SIGNS}{BORROWED}{HARD}]", *(f"{c}{PULLI}[^{SIGNS}{BORROWED}{HARD}{AFTER_SOFT}{c}]" for c in SOFT), f"[{MIDDLE}]{PULLI}[^{SIGNS}{BORROWED}{CONSONANTS}]", *(f"{c}{PULLI}{c}" for c in SINGLE)]
)
LETTER = f"(?:[{VOWELS}{AYTHAM}]|[{CONSONANTS}{BORROWED}][{VOWEL_SIGNS}{PULLI}]?)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def letter_defect(unit: Column) -> Column:
    """Why a cluster is no letter: empty, base, standalone (a vowel or the aytham with a sign), signs (more than one) or sign; null for letters."""
    base, marks = F.substring(unit, 1, 1), F.substr(unit, F.lit(2))
    alone = base.isin(*VOWELS, AYTHAM)
    return (
        F.when(F.length(unit) == 0, "empty")
        .when(~base.isin(*VOWELS, *CONSONANTS, *BORROWED, AYTHAM), "base")
        .when(alone & (marks != ""), "standalone")
        .when(F.length(marks) > 1, "signs")
        .when((marks != "") & ~marks.isin(*VOWEL_SIGNS, PULLI), "sign")
    )


def roman(unit: Column) -> Column:
    """The ASCII label of a letter, by its parts; null for what is none."""
    base, mark = F.substring(unit, 1, 1), F.substr(unit, F.lit(2))
    signs = {"": VOWEL_ROMAN[0], PULLI: ""} | dict(zip(VOWEL_SIGNS, VOWEL_ROMAN[1:], strict=True))
    alone = dict(zip(VOWELS, VOWEL_ROMAN, strict=True)) | {AYTHAM: AYTHAM_ROMAN}
    whole = F.coalesce(F.element_at(_map(alone), base), F.concat(F.element_at(_map(CONSONANT_ROMAN), base), F.element_at(_map(signs), mark)))
    return F.when(letter_defect(unit).isNull(), whole)


def begins_like_a_word(parts: Column) -> Column:
    """A vowel, or an opening consonant that bears one."""
    first = F.get(parts, F.lit(0))
    kind = unit_kind(first)
    return F.coalesce((kind == "uyir") | (kind == "uyirmei") & first.rlike(f"^[{OPENING}]"), F.lit(False))


def ends_like_a_word(parts: Column) -> Column:
    """Anything but a consonant without a vowel that may not close a word."""
    last = F.try_element_at(parts, F.lit(-1))
    return last.isNotNull() & ((unit_kind(last) != "mei") | last.isin(*(c + PULLI for c in CLOSING)))


def has_foreign(word: Column) -> Column:
    """Whether some cluster is of no Tamil base; true for the empty word."""
    return (F.length(word) == 0) | word.rlike(f"[^அ-ஔ{AYTHAM}க-ஹ{SIGNS}]|^[{SIGNS}]")


def shape(word: Column) -> Column:
    """initial_legal, final_legal, clusters_legal, has_grantha and has_foreign of a word, and whether all its clusters are letters; the empty word has none and is foreign."""
    parts, some = units(word), F.length(word) > 0
    return F.struct(
        begins_like_a_word(parts).alias("initial_legal"),
        ends_like_a_word(parts).alias("final_legal"),
        (some & ~word.rlike(BAD_CLUSTER)).alias("clusters_legal"),
        word.rlike(f"[{BORROWED}]").alias("has_grantha"),
        has_foreign(word).alias("has_foreign"),
        (some & word.rlike(f"^{LETTER}*$")).alias("all_letters"),
    )


def orthotactic(of: Column, initial: float, final: float, cluster: float, grantha: float) -> Column:
    """1 less the weights of what a shape breaks, 0 at least and for foreign words."""
    cost = lambda broken, weight: F.when(broken, weight).otherwise(0.0)
    total = cost(~of["initial_legal"], initial) + cost(~of["final_legal"], final) + cost(~of["clusters_legal"], cluster) + cost(of["has_grantha"], grantha)
    return F.when(of["has_foreign"], 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - total), 6))


def ends_in_suffix(parts: Column, tail: tuple[str, ...], link: str, least_stem: int) -> Column:
    """Whether a word ends in the units `tail`, linked to a consonant by the vowel sign `link`, after `least_stem` units or more."""
    n = len(tail)
    joint = F.try_element_at(parts, F.lit(-n - 1))
    long = F.size(parts) >= n + 1 + least_stem
    return F.coalesce(long & (F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)) == F.array(*map(F.lit, tail))) & (F.substr(joint, F.lit(2)) == link), F.lit(False))
