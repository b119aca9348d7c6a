"""Pages of a Tamil wiki dictionary to facts about their titles.

A page is a sequence of blocks, each opened by a heading, a rule or a section template; what a line says depends on its
block. Lines and their segments become rows, the block is the last one opened before, and each kind of block has its
own expression. All of it is DataFrame functions; a page of any length is no group of any task but in its ordering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.texts import tokens
from wordloom.operators.classes import _LEAD, OPEN, OPENED, PLAIN, WRITTEN, spelled
from wordloom.sources.shared import kept, spread
from wordloom.sources.tables import table

# Fixed values of the wiki: what its sections hold by name, its parts of speech by name, and the names of links that are no words.
MEANING = ("பொருள்", "விளக்கம்")
TRANSLATION = ("மொழிபெயர்ப்பு", "மொழிபெயர்ப்புகள்")
ENGLISH = ("ஆங்கிலம்", "ஆங்", "ஆங்கி", "ஆங்கில", "ஆங்தலை")
SYNONYM = ("ஒத்த சொற்கள்", "ஒத்தச்சொல்", "ஒத்தச்சொற்கள்", "ஒத்தசொல்", "ஒத்த கருத்துள்ள சொற்கள்")
LANGUAGE = "மொழி"
OTHER = (
    "மொழிபெயர்ப்புகளைச்சேர்", "பயன்பாடு", "இலக்கியமை", "இலக்கியம்", "இலக்கணமை", "வரியமை", "சொல் வளப்பகுதி", "சொல்வளம்", "சொல்வளப் பகுதி", "சொற்குவை", "ஒலிப்பு", "ஒலிக்கோப்பு", "பலுக்கல்", "உசாத்துணை",
    "மேற்கோள்", "மேற்கோள்கள்", "ஆதாரம்", "ஆதாரங்கள்", "ஆதா", "தமிழ்ஆதாரங்கள்", "ஆங்ஆதாரம்", "ஆங்கில ஆதாரங்கள்", "எ. கா.", "எ.கா", "எடுத்துக்காட்டு", "சொற்றொடர் எடுத்துக்காட்டு", "சொற்பிறப்பியல்", "சொற்பிறப்பு", "சொற்தோற்றம்",
    "பிறமொழிகளில்", "தொடர்புடையச் சொற்கள்", "தொடர்புடையச்சொற்கள்", "நீலஅடிக்கோடு", "அடிக்கோடிடு", "தமிழில் விளக்கவும்", "விரிவாக்குக", LANGUAGE, "சிறு-மொழி", "தமிழ்", "தமி", "சொல்",
)
PARTS_OF_SPEECH = {
    "பெயர்ச்சொல்": ("பெயர்ச்சொல்", "பெயர்ச்சொற்கள்", "பெ"),
    "வினைச்சொல்": ("வினைச்சொல்", "வினைச்சொற்கள்", "வி", "வினை"),
    "உரிச்சொல்": ("உரிச்சொல்", "உரிச்சொற்கள்"),
    "இடைச்சொல்": ("இடைச்சொல்", "இடைச்சொற்கள்"),
    "எண்": ("எண்",),
    "வினையுரிச்சொல்": ("வினையுரிச்சொல்",),
}
CATEGORY = ("பகுப்பு", "category")
NO_WORDS = (*CATEGORY, "படிமம்", "படம்", "வார்ப்புரு", "file", "image", "media")
#: Values of one kind that a page may have; characters of a translation.
MOST_VALUES, MOST_TRANSLATION = 24, 64
#: Pages that a task parses.
PARSED_PAGES = 500

TAMIL, SPACE = "\u0b80-\u0bff", "\\s\\p{Z}\\x1c-\\x1f\\x85"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: A template, with templates inside it one level deep; its name.
MARKER = f"\\{{\\{{[{SPACE}]*([^{{}}|\\n]*?)[{SPACE}]*(?:\\|(?:[^{{}}]|\\{{\\{{[^{{}}]*\\}}\\}})*)?\\}}\\}}"
TRAILING, BRACKETED = f"[{SPACE}.,;:\\-]+$", "\\([^()]*\\)"
REDIRECT, HEADING = "(?i)^\\s*#\\s*redirect\\b", f"^[{SPACE}]*=+[{SPACE}]*(.*?)[{SPACE}]*=+[{SPACE}]*$"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _looked_up(name: Column, pairs: dict[str, str]) -> Column:
    """What the name stands for: as it is, without digits at its end, or by what comes before its first hyphen."""
    known = _map(pairs)
    return F.coalesce(F.element_at(known, name), F.element_at(known, F.regexp_replace(name, "[0-9]+$", "")), F.element_at(known, F.substring_index(name, "-", 1)))


def _section(name: Column) -> Column:
    pairs = {n: kind for kind, names in (("meaning", MEANING), ("translation", TRANSLATION + ENGLISH), ("synonym", SYNONYM), ("other", OTHER)) for n in names}
    return _looked_up(F.when(name.rlike("^=.+=$"), LANGUAGE).otherwise(name), pairs)


def _part_of_speech(name: Column) -> Column:
    return _looked_up(name, {n: tag for tag, names in PARTS_OF_SPEECH.items() for n in names})


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def cleaned(text: Column) -> Column:
    """A segment of markup as the text that a reader sees: without comments, references, templates, tags and list marks, links by their label."""
    out = F.regexp_replace(text, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?is)<ref\\b[^>]*/>|<ref\\b[^>]*>.*?</ref>", " ")
    for _ in range(3):
        out = F.regexp_replace(out, "\\{\\{[^{}]*\\}\\}", " ")
    out = F.regexp_replace(out, f"\\[(?:https?|ftp)://[^{SPACE}]*[{SPACE}]*([^\\]]*)\\]", " $1 ")
    link = f"(?iu)\\[\\[(?:[{SPACE}]*(?:{'|'.join(NO_WORDS)})[{SPACE}]*:[^\\[\\]|]*(?:\\|[^\\[\\]]*)?|[^\\[\\]|]*\\|([^\\[\\]]*)|([^\\[\\]|]*))\\]\\]"
    for _ in range(3):  # a caption may hold links
        out = F.regexp_replace(out, link, "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, "</?[A-Za-z][^<>]{0,200}>", " "), "'{2,5}", "")
    out = F.when(text.rlike("[<{\\[']"), out).otherwise(text)  # most texts have nothing of that
    out = F.regexp_replace(F.translate(out, "{}[]", "    "), f"^[#*:;=\\-{SPACE}.]+", "")
    return trimmed(F.regexp_replace(F.regexp_replace(out, TRAILING, ""), f"[{SPACE}]+", " "))


def _parts(text: Column) -> Column:
    pieces = F.transform(F.split(text, "[,;]"), lambda x: F.regexp_replace(trimmed(x), TRAILING, ""))
    return F.filter(pieces, lambda x: x != "")


def _told(block: Column, text: Column) -> Column:
    """What a block of this kind is read for in a cleaned segment: without what trails a meaning, or stands before and beside a translation."""
    meaning = F.regexp_replace(F.regexp_replace(text, f"([{TAMIL}][^,;]*)[,;][^{TAMIL}]*$", "$1"), TRAILING, "")
    translation = F.regexp_replace(F.regexp_replace(text, BRACKETED, " "), f"^[^A-Za-z]*?[{TAMIL}][^A-Za-z]*?-[{SPACE}]*(.+)$", "$1")
    return F.when(block == "meaning", meaning).when(block == "translation", translation).otherwise(text)


def _said(block: Column, text: Column, parts: Column, terms: Column, title: Column) -> Column:
    """definition, synonyms and translations of a text that was told (_told()), by its parts and its terms; null parts for a meaning without one."""
    nothing, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    values = F.filter(parts, lambda x: (F.length(x) <= MOST_TRANSLATION) & x.rlike("^[A-Za-z][A-Za-z '\\-.]*$"))
    definition = F.when((block == "meaning") & parts.isNotNull() & (text != title), text).otherwise(none)
    synonyms = F.when(block.isin("meaning", "synonym") & parts.isNotNull(), terms).otherwise(nothing)
    translations = F.when(block == "translation", values).otherwise(nothing)
    read = F.when(block == "meaning", parts.isNotNull()).when(block == "translation", F.size(values) > 0).otherwise(F.size(terms) > 0)
    return F.struct(definition.alias("definition"), synonyms.alias("synonyms"), translations.alias("translations"), read.alias("read"))


def _segments(lines: DataFrame) -> DataFrame:
    """Lines (column source) with `names`, the templates of those that are no heading (null: none), and `segments`: each with the block that it opens (null for what goes on) and whether it is the whole line.

    What several expressions use is a column, so that it is worked out once.
    """
    one = lambda block, text, whole: F.struct(block.cast("string").alias("block"), text.alias("text"), whole.alias("whole"))
    source, names, marks, texts, blocks = (F.col(c) for c in ("source", "names", "marks", "texts", "blocks"))
    lines = lines.withColumn("heading", source.rlike(HEADING))
    templates = ~F.col("heading") & F.contains(source, F.lit("{{"))
    lines = lines.withColumns({"names": F.when(templates, F.regexp_extract_all(source, F.lit(MARKER), 1)), "name": F.when(F.col("heading"), cleaned(F.regexp_extract(source, HEADING, 1)))})
    some = F.coalesce(F.size(names) > 0, F.lit(False))
    lines = lines.withColumns({"marks": F.when(some, F.regexp_extract_all(source, F.lit(f"({MARKER})"), 1)), "texts": F.when(some, F.split(source, MARKER, -1)), "blocks": F.when(some, F.transform(names, _section))})

    def step(done: Column, k: Column) -> Column:
        block, text = F.get(blocks, k), F.get(texts, k + 1)
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one(last["block"], F.concat(last["text"], F.get(marks, k), text), F.lit(False))))
        return F.when(block.isNotNull(), F.concat(done, F.array(one(block, text, F.lit(False))))).otherwise(longer)

    start = F.array(one(F.lit(None), F.get(texts, F.lit(0)), F.lit(False)))
    lines = lines.withColumn("cut", F.when(some, F.aggregate(F.sequence(F.lit(0), F.size(marks) - 1), start, step)))
    empty, no = F.lit(""), F.lit(False)
    opened = F.when(F.col("name").isin(*ENGLISH), "other").otherwise(F.coalesce(_section(F.col("name")), F.lit("other")))  # as a heading it is a language
    whole = F.when(F.size("cut") == 1, F.transform("cut", lambda s: one(s["block"], s["text"], F.lit(True)))).otherwise(F.col("cut"))
    segments = (
        F.when(F.col("heading"), F.array(one(opened, empty, no)))
        .when(source.rlike(f"^[{SPACE}]*-{{4,}}[{SPACE}]*$"), F.array(one(F.lit("lead"), empty, no)))
        .when(F.col("cut").isNull(), F.array(one(F.lit(None), source, F.lit(True))))
        .otherwise(whole)
    )
    return lines.withColumn("segments", segments)


def harvested(pages: DataFrame) -> DataFrame:
    """page, title, line, segment, and what is said there (_said(), and `parts_of_speech`), of the lines of pages (page, title, text). Redirects say nothing."""
    lines = pages.where(~F.col("text").rlike(REDIRECT)).select("page", "title", F.posexplode(F.split("text", LINE_END)).alias("line", "source"))
    none = F.array().cast("array<string>")
    tags = F.when(F.col("names").isNotNull(), F.array_compact(F.transform("names", _part_of_speech))).otherwise(none)
    # there is a segment at least; for posexplode() Spark would filter lines by all that segments are made of, and so make them twice
    cut = _segments(lines).select("page", "title", "line", tags.alias("tags"), F.posexplode_outer("segments").alias("segment", "s"))
    so_far = Window.partitionBy("page").orderBy("line", "segment").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("block", F.coalesce(F.last("s.block", ignorenulls=True).over(so_far), F.lit("lead")))
    numbered = F.col("s.whole") & F.ltrim("s.text").startswith("#")
    kind = F.when(F.col("block") != "lead", F.col("block")).when(numbered, "meaning").otherwise("other")
    cut = cut.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") != "other", cleaned(F.col("s.text"))))
    block, body, parts, title = F.col("kind"), F.col("body"), F.col("parts"), F.col("title")
    cut = cut.withColumn("body", F.when(F.col("text") != "", _told(block, F.col("text"))))
    told = (block != "meaning") | body.rlike(f"[{TAMIL}]") & F.regexp_replace(body, BRACKETED, "").rlike("[^ .,;:\\-]")
    cut = cut.withColumn("parts", F.when(told, _parts(body)))
    terms = F.when(F.forall(parts, lambda x: x.rlike(f"^[{TAMIL}]+$")), F.filter(parts, lambda x: x != title)).otherwise(none)  # nothing but Tamil words between commas
    cut = cut.withColumn("terms", F.when(block != "translation", terms))
    said = F.when(body.isNotNull(), _said(block, body, parts, F.col("terms"), title))
    return cut.select("page", "title", "line", "segment", said.alias("said"), F.when(F.col("segment") == 0, F.col("tags")).alias("parts_of_speech"))


def wiki_facts(pages: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """page, word, attr, value and ordinal: what each page (page, its key; title; text) says of its title.

    attr is definition, synonym, translation or pos, each value once, in the order of the page, `most` at most; and
    headword for pages that say anything. Titles have spaces for underscores. Pages without a title or text say nothing.
    pages are counted, and read twice; they should be a table.
    """
    title = trimmed(F.regexp_replace(F.translate("title", "_", " "), f"[{SPACE}]+", " "))
    named = spread(pages, PARSED_PAGES, "page").select("page", title.alias("title"), "text").where("title <> '' AND text IS NOT NULL")
    found = harvested(named)
    values = lambda attr, array: F.transform(array, lambda v, i: F.struct(F.lit(attr).alias("attr"), v.alias("value"), i.alias("i")))
    some = F.concat(
        values("definition", F.when(F.col("said.definition").isNotNull(), F.array("said.definition")).otherwise(F.array().cast("array<string>"))),
        values("synonym", F.coalesce("said.synonyms", F.array().cast("array<string>"))),
        values("translation", F.coalesce("said.translations", F.array().cast("array<string>"))),
        values("pos", F.coalesce("parts_of_speech", F.array().cast("array<string>"))),
    )
    each = found.select("page", "title", "line", "segment", F.explode(some).alias("v")).select("page", "title", "v.attr", "v.value", F.struct("line", "segment", "v.i").alias("at"))
    category = f"(?iu)\\[\\[[{SPACE}]*(?:{'|'.join(CATEGORY)})[{SPACE}]*:[{SPACE}]*([^\\[\\]|]+?)[{SPACE}]*(?:\\|[^\\[\\]]*)?\\]\\]"
    filed = named.where(~F.col("text").rlike(REDIRECT)).select("page", "title", F.posexplode(F.regexp_extract_all("text", F.lit(category), 1)).alias("i", "name"))
    filed = filed.select("page", "title", F.lit("pos").alias("attr"), _part_of_speech(F.col("name")).alias("value"), F.struct(F.lit(2**31 - 1).alias("line"), F.lit(0).alias("segment"), "i").alias("at"))
    once = each.unionAll(filed.where("value IS NOT NULL")).groupBy("page", "title", "attr", "value").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("page", "attr").orderBy("at")) - 1
    ranked = once.withColumn("ordinal", place).where(F.col("ordinal") < most)
    first = F.row_number().over(Window.partitionBy("page").orderBy("attr", "at")) == 1
    row = lambda attr, value, ordinal: F.struct(F.lit(attr).alias("attr") if isinstance(attr, str) else attr, value.alias("value"), ordinal.alias("ordinal"))
    itself, head = row(F.col("attr"), F.col("value"), F.col("ordinal")), row("headword", F.col("title"), F.lit(0))
    rows = ranked.withColumn("first", first).select("page", F.col("title").alias("word"), F.explode(F.when(F.col("first"), F.array(head, itself)).otherwise(F.array(itself))).alias("r"))
    return rows.select("page", "word", "r.attr", "r.value", "r.ordinal")


def unread(pages: DataFrame) -> DataFrame:
    """page, read and skipped: of the segments that blocks were read for, those that said something, and those that did not."""
    return harvested(spread(pages, PARSED_PAGES, "page").where("text IS NOT NULL")).where("said IS NOT NULL").groupBy("page").agg(F.count_if("said.read").alias("read"), F.count_if(~F.col("said.read")).alias("skipped"))


def _paged(conversations: DataFrame) -> DataFrame:
    opening = F.regexp_extract(F.lower("text"), "^(?:[^a-y]*+[a-y]++){3}", 0)  # as far as the third word
    turns = conversations.withColumn("e", tokens(opening, "[a-y]+")).where(F.size("e") >= 3).withColumn("w", F.transform(F.slice("e", 1, 3), spelled))
    first, second, third = (F.col("w")[k] for k in range(3))
    lit = F.lit
    user = F.concat(lit("{{பெயர்ச்சொல்}} {{பொருள்-x}} [["), first, lit("|"), second, lit("]] '''"), third, lit("''' (rare)<!-- no -->.<ref>x</ref>"))
    other = F.concat(lit("{{ஆங்கிலம்|{{PAGENAME}}}} ஆங்கிலம் - "), F.col("e")[0], lit(", "), F.col("e")[1], lit("\n* "), first)
    rest = F.concat(lit("\n----\n# "), first, lit("; "), second, lit(", [[x y]]\n=== ஒத்தச்சொல்2 ===\n* [["), first, lit("]], [["), third, lit("|"), second, lit("]], [[பகுப்பு:"), third, lit("]]\n== ஆங்கிலம் ==\n# "), third)
    each = turns.select("conv_id", "turn", "w", F.concat(F.when(F.col("role") == "user", user).otherwise(other), rest).alias("markup"))
    listed = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "markup", "w"))).alias("l"))
    return listed.select(F.col("conv_id").alias("page"), F.col("l")[0]["w"][0].alias("title"), F.array_join(F.col("l")["markup"], "\n").alias("text"))


def conversation_pages(spark: SparkSession, d: str) -> DataFrame:
    """page, title and text: conversations as pages of the wiki, their turns' first three words spelled in Tamil. Turns with fewer are left out. Made once for all queries over the same table."""
    return kept(spark, "wiki_pages", d, ("conversations",), lambda: _paged(table(spark, d, "conversations")))


def wiki_page_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of conversation_pages()."""
    return wiki_facts(conversation_pages(spark, d))


def wiki_page_ledger(spark: SparkSession, d: str) -> DataFrame:
    """page, read and skipped of conversation_pages()."""
    return unread(conversation_pages(spark, d))


_SPELL: Callable[[str], str] = lambda surface: f"(SELECT translate(translate(substr(j, 1, 1), '{OPEN}', '{OPENED}'), '{PLAIN}', '{WRITTEN}') || translate(substr(j, 2), '{PLAIN}', '{WRITTEN}') FROM (SELECT {_LEAD.replace('surface', surface)} AS j))"
_TURNS = f"""t AS (SELECT conv_id, turn, role = 'user' AS u, regexp_extract_all(lower(coalesce(text, '')), '[a-y]+') AS e FROM conversations), w AS (SELECT conv_id, turn, u, e, {_SPELL("e[1]")} AS a, {_SPELL("e[2]")} AS b, {_SPELL("e[3]")} AS c FROM t WHERE len(e) >= 3)"""
QUERIES = {"wiki_page_facts": wiki_page_facts, "wiki_page_ledger": wiki_page_ledger}
#: What the pages were made to say, without a parser.
ORACLES = {
    "wiki_page_facts": f"""WITH {_TURNS}, p AS (SELECT conv_id, arg_min(a, turn) AS title FROM w GROUP BY 1), v AS (SELECT w.*, title FROM w JOIN p USING (conv_id)),
f AS (SELECT conv_id, title, 'definition' AS attr, b || ' ' || c || ' (rare)' AS value, turn * 10 AS o FROM v WHERE u UNION ALL SELECT conv_id, title, 'definition', a || '; ' || b, turn * 10 + 1 FROM v
UNION ALL SELECT conv_id, title, 'synonym', a, turn * 10 FROM v WHERE a <> title UNION ALL SELECT conv_id, title, 'synonym', b, turn * 10 + 1 FROM v WHERE b <> title
UNION ALL SELECT conv_id, title, 'translation', e[1], turn * 10 FROM v WHERE NOT u AND len(e[1]) <= {MOST_TRANSLATION} UNION ALL SELECT conv_id, title, 'translation', e[2], turn * 10 + 1 FROM v WHERE NOT u AND len(e[2]) <= {MOST_TRANSLATION}
UNION ALL SELECT conv_id, title, 'pos', 'பெயர்ச்சொல்', turn FROM v WHERE u UNION ALL SELECT conv_id, title, 'pos', tag, 1000000 + turn FROM v JOIN (VALUES {", ".join(str((n, tag)) for tag, names in PARTS_OF_SPEECH.items() for n in names)}) n(name, tag) ON name = c), g AS (SELECT conv_id, title, attr, value, min(o) AS o FROM f GROUP BY ALL),
k AS (SELECT conv_id AS page, title AS word, attr, value, CAST(row_number() OVER (PARTITION BY conv_id, attr ORDER BY o) - 1 AS INTEGER) AS ordinal FROM g)
SELECT * FROM k WHERE ordinal < {MOST_VALUES} UNION ALL SELECT DISTINCT page, word, 'headword', word, 0 FROM k""",
    "wiki_page_ledger": f"""WITH {_TURNS}, p AS (SELECT conv_id, arg_min(a, turn) AS title FROM w GROUP BY 1)
SELECT conv_id AS page, CAST(sum(CASE WHEN u THEN 1 ELSE 0 END + CASE WHEN NOT u THEN 1 ELSE 0 END + 1 + CASE WHEN a <> title OR b <> title THEN 1 ELSE 0 END) AS BIGINT) AS read,
  CAST(sum(CASE WHEN u THEN 0 ELSE 1 END + CASE WHEN a <> title OR b <> title THEN 0 ELSE 1 END) AS BIGINT) AS skipped FROM w JOIN p USING (conv_id) GROUP BY 1""",
}
