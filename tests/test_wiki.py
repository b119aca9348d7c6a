"""Wiki pages against facts worked out by hand, and cleaning of markup."""

import pytest
from pyspark.sql import functions as F

from wordloom.operators import wiki

PAGES = {
    "கடல்": (
        "ஒலி: x\n# முதல் பொருள், [[நீர்]] நிறைந்தது; Pacific ; sea\n* பட்டியல்\n{{பொருள்}} * பெரிய [[நீர்நிலை|நீர்ப்பரப்பு]]<ref name=a/> (பெ).\n:(பெ)\n{{பயன்பாடு}} # ஒரு வரி\n----\n#ஆழி, பரவை, கடல்",
        {"definition": ["முதல் பொருள், நீர் நிறைந்தது", "பெரிய நீர்ப்பரப்பு (பெ)", "ஆழி, பரவை, கடல்"], "synonym": ["ஆழி", "பரவை"]},
    ),
    "ஓடு": (
        "== தமிழ் ==\n# எதுவுமில்லை\n{{வினை}} {{வி-x}} {{பெ3}}\n{{மொழிபெயர்ப்புகள்}} ஆங்கிலம் - run, flee (away) ; to go fast\n* {{ஆங்}} tile - (ஆங்கிலம்)\n* 123, ஓடு\n===ஒத்தசொல்===\n* விரை, பாய்\n* ஓடு, நட்\n* விரை பாய்\n[[பகுப்பு: உரிச்சொற்கள்|x]] [[category:எண்]] [[category:zzz]]",
        {"pos": ["வினைச்சொல்", "பெயர்ச்சொல்", "உரிச்சொல்", "எண்"], "translation": ["run", "flee", "to go fast", "tile"], "synonym": ["விரை", "பாய்", "நட்"]},
    ),
    "நாய்": ("#REDIRECT [[நாய்கள்]]\n# ஒரு விலங்கு", {}),
    "பூனை": ("just words\n{{=ta=}}\n# விலங்கு", {}),
    "மரம்": ("\n".join(f"# சொல்{chr(0x0B95 + k % 20)}{chr(0x0BBE + k // 20)} ஒன்று" for k in range(30)), {"definition": [f"சொல்{chr(0x0B95 + k % 20)}{chr(0x0BBE + k // 20)} ஒன்று" for k in range(24)]}),
    "வாழை": ("{{பொருள்}} பழம் {{குறிப்பு|{{x|{{y}}}}}} தரும் {{படம்\n|கோடு}} மரம்\n{{விளக்கம்}} [[படிமம்:a.png|thumb|ஒரு [[மரம்|மரத்தின்]] படம்]] இலை [http://a.b/c பார்க்க]", {"definition": ["பழம் தரும் படம்", "|கோடு மரம்", "இலை பார்க்க"]}),
}


def test_pages(spark):
    rows = [(k, t.replace(" ", "_"), text) for k, (t, (text, _)) in enumerate(PAGES.items())] + [(100, None, "# பொருள்"), (101, " _ ", "# பொருள்"), (102, "வெறுமை", None), (103, "வெறுமை", ""), (104, "இரு_ சொல்", "# ஒரு பொருள்")]
    pages = spark.createDataFrame(rows, "page int, title string, text string")
    found = {}
    for r in wiki.wiki_facts(pages).orderBy("page", "attr", "ordinal").collect():
        found.setdefault(r.word, {}).setdefault(r.attr, []).append(r.value)
    for title, (_, want) in PAGES.items():
        assert found.get(title, {}) == (want | {"headword": [title]} if want else {}), title
    assert found["இரு சொல்"] == {"definition": ["ஒரு பொருள்"], "headword": ["இரு சொல்"]} and len(found) == 5
    counted = {r.page: (r.read, r.skipped) for r in wiki.unread(pages).collect()}
    assert counted[0] == (3, 1) and counted[1] == (4, 2)
    assert wiki.wiki_facts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("markup, want", [("'''a''' [[b|c]] {{d|{{e}}}} <b>f</b>", "a c f"), ("# * a<!-- x --> b .,", "a b"), ("[[File:x|a]] [[ category : y]]z", "z"), ("{{unclosed a", "unclosed a"), ("<ref>a</ref>b<REF c>d</REF>", "b"), ("[[a|b|c]]", "b|c")])
def test_cleaned(spark, markup, want):
    assert spark.range(1).select(wiki.cleaned(F.lit(markup)).alias("x")).first().x == want
