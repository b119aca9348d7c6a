"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import bpe_transducer, decontaminate, html_text, near_dups, quality_rules, substring_dedup, suffix_dedup, token_counts, url_trust, warc
from wordloom.llm.suffix_dedup import search_bytes

LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
LONG = " ".join(f"w{k}" for k in range(60_000))
TEXTS = [(1, LINE), (2, LINE), (2, LINE), (2, "other text here"), (3, None), (4, ""), (5, " \n\t "), (None, LINE), (None, None), (6, LONG), (7, "x " + LINE + " y"), (8, "é" * 300), (9, "é" * 300), (10, "ab " * 400)]
CLASH = "marks string, place long, n_words string, digest int, rest string, w int, hit string"


def docs_of(spark, texts=TEXTS):
    rows = [(k, t, None if k == 5 else "en", None if k == 4 else "src", 1, "m", 2, "n", 3, "r", 4, "h") for k, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, size int")


OPERATORS = {
    "quality": lambda d, b: quality_rules.judge(d),
    "cleaned": lambda d, b: quality_rules.cleaned(d),
    "near": lambda d, b: near_dups.near_duplicates(d),
    "leaks": lambda d, b: decontaminate.report(d, b),
    "substrings": lambda d, b: substring_dedup.report(d),
    "substring texts": lambda d, b: substring_dedup.dedup(d, ["lang", "marks", "place"]),
    "suffixes": lambda d, b: suffix_dedup.report(d),
    "counts": lambda d, b: token_counts.token_counts(d, P.path("byte_bpe_50k.json"), P.PATTERN),
    "transducer": lambda d, b: bpe_transducer.encode_decode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    bench = spark.createDataFrame([("a", LINE), ("b", None), ("c", ""), (None, "other text here")], "item_id string, text string")
    for texts in (TEXTS, []):
        found = OPERATORS[name](docs_of(spark, texts), bench).collect()
        assert len(found) == len(texts) or name == "cleaned" and len(found) < len(texts)


def test_near_duplicates(spark):
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs_of(spark)).collect()]
    assert found.count((2, 12, 1, False)) == 2 and (1, 12, 1, True) in found
    assert (3, 0, 3, True) in found and (4, 0, 4, True) in found and (9, 1, 8, False) in found
    assert (2, 1, 2, True) in found and (7, 14, 1, False) in found
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs_of(spark), "").withColumn("_id", F.lit(1)).collect()]
    assert (2, "other text here") in kept and (2, LINE) not in kept and (1, LINE) in kept and kept.count((None, LINE)) == 1


def test_substrings(spark):
    found = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.report(docs_of(spark)).collect()]
    assert found.count((2, 16, 16)) == 2 and (1, 16, 16) in found and (None, 16, 0) in found
    assert (7, 18, 16) in found and (2, 3, 0) in found and (6, 60_000, 0) in found and (3, 0, 0) in found
    assert (10, 400, 0) in found  # repeats of one document are not earlier


def test_suffixes(spark):
    """Of 300 two-byte letters only the first two places have strings that do not stand earlier; of 400 times three bytes, the first three."""
    found = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs_of(spark)).collect()}
    assert found[9, 600][:2] == (600, 1) and found[8, 600][:2] == (598, 1)
    assert found[10, 1200][:2] == (1197, 1) and found[3, 0] == (0, 0, hashlib.sha256(b"").hexdigest())


def test_values_of_odd_rows(spark):
    """What each operator says of null, empty, white and repeated rows."""
    bench = spark.createDataFrame([("a", LINE), ("b", None), ("c", ""), (None, "other text here")], "item_id string, text string")
    judged = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(docs_of(spark)).collect()]
    assert judged.count((2, 16, True, False)) == 2 and (3, 0, True, False) in judged and (4, 0, True, False) in judged and (6, 60_000, False, True) in judged
    leaks = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs_of(spark), bench).collect()]
    assert leaks.count((2, 16, 16, 1, True)) == 2 and (2, 3, 3, 0, True) in leaks and (3, 0, 0, 0, False) in leaks and (None, 16, 16, 1, True) in leaks and (7, 18, 16, 1, True) in leaks
    counts = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs_of(spark), P.path("byte_bpe_50k.json"), P.PATTERN).collect()]
    assert counts.count((3, 0, 0)) == 1 and (4, 0, 0) in counts and len([c for c in counts if c[:2] == (2, len(LINE))]) == 2 and (None, 0, 0) in counts
    coded = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe_transducer.encode_decode(docs_of(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    assert (3, 0, b"", b"") in coded and (None, 0, b"", b"") in coded and {c[3] for c in coded if c[0] == 2} == {LINE.encode(), b"other text here"}


def test_run_index_on_ties():
    import numpy as np

    fragments = [b"ab" * 60, b"ab" * 60, b"ba" * 60]
    n = np.array([21, 21, 21])
    found = search_bytes(pa.array(fragments, pa.binary()), np.arange(3), n)
    seen, want = set(), []
    for f in fragments:
        for k in range(21):
            want.append(f[k : k + 100] in seen)
            seen.add(f[k : k + 100])
    assert found.tolist() == want


def test_pages(spark):
    long = "<p>" + "Text, and more. " * 100 + "</p>"
    rows = [(1, "http://A.net/x?y", long), (2, None, long), (2, None, long), (3, "no host", None), (None, "http://b.org/fr/", ""), (4, "http://example.net/en/", "<a href=http://A.net/>"), (5, "", "<p>" * 5000)]
    for given in (rows, []):
        pages = pages_of(spark, given)
        assert url_trust.judge(pages).count() == len(given)
        assert html_text.extract(pages).count() == len(given)
    judged = {(r.page_id, r.rule, r.verdict) for r in url_trust.judge(pages_of(spark, rows)).collect()}
    assert (1, "net/", "block") in judged and (None, "org/fr/", "allow") in judged and (4, "example.net/en/", "allow") in judged and (3, None, "allow") in judged


def test_warc_is_the_same_every_time(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a/\n%0A", long), (2, None, long), (2, None, long), (3, "x", None), (None, "n", long), (4, "y", "short"), (5, "z", "short")]
    made = []
    for k in range(2):
        pages = pages_of(spark, rows if not k else rows[::-1]).repartition(3 - k)
        listed = warc.write(pages, f"file://{tmp_path}/{k}", shard_bytes=1000, file_bytes=300)
        made.append(sorted(map(tuple, listed.collect())))
        back = warc.read(spark, f"file://{tmp_path}/{k}").collect()
        assert sorted((r.page_id or 0, r.url or "", r.record_type, r.refers_to or 0) for r in back) == sorted(
            [(1, "http://a/\n%0A", "revisit", 2), (2, "", "response", 0), (2, "", "response", 0), (3, "x", "response", 0), (0, "n", "revisit", 2), (4, "y", "response", 0), (5, "z", "response", 0)]
        )
        assert all(r.payload_bytes == 1200 for r in back if r.page_id in (1, 2)) and all(bytes(r.payload).decode() == long for r in back if r.page_id == 2)
    assert made[0] == made[1] and len(made[0]) > 1
    assert warc.read(spark, warc_folder(spark, tmp_path)).count() == 0


def warc_folder(spark, tmp_path):
    warc.write(pages_of(spark, []), f"file://{tmp_path}/none")
    return f"file://{tmp_path}/none"


def test_stages(spark, tmp_path):
    spark.createDataFrame([("a", LINE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for texts in (TEXTS, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs_of(spark, texts), str(tmp_path)).collect()


def test_lines_that_most_of_a_host_shares(spark):
    """Sixty documents of ten shared and two own lines lose the shared ones; sixty copies of one document lose nothing."""
    known = sorted((" ".join(f"{c}{k}" for c in "abcdefg") for k in range(2000)), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    own = [[f"own{j}n{k} x{j}n{k} y{j}n{k}" for j in range(2)] for k in range(60)]
    rows = [(k, "\n".join([*known[:10], *own[k]]), "boiler") for k in range(60)] + [(100 + k, "\n".join(known[10:22]), "copies") for k in range(60)]
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.source, r.n_removed_words, r.base_failed, r.kept) for r in found if r.source == "boiler"} == {("boiler", 70, False, False)}
    assert {r.n_removed_words for r in found if r.source == "copies"} == {0}


def test_trust_reaches_far_and_does_not_depend_on_size(spark):
    """A host twelve links before a blocked seed, and one of a hundred before a one-page seed among a million blocked pages."""
    link = lambda to: f"<a href=http://{to}/>"
    chain = [(k, f"http://far{k}.biz/", link(f"far{k - 1}.biz" if k > 1 else "end.net")) for k in range(1, 13)]
    rows = [*chain, (20, "http://end.net/", ""), (21, "http://one.net/", ""), (22, "http://clean.biz/", ""), *((100 + k, f"http://near{k}.biz/", link("one.net")) for k in range(100))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    many = spark.range(1000, 1_001_000).selectExpr("id AS page_id", "'http://big.net/' AS url", "'' AS html")
    verdicts = {r.page_id: (r.verdict, r.distrust) for r in url_trust.judge(pages.unionAll(many)).where("page_id < 1000").collect()}
    assert all(verdicts[k][1] is not None and verdicts[k][0] == "block" for k in range(1, 13))
    assert {verdicts[100 + k][0] for k in range(100)} == {"block"} and verdicts[22] == ("allow", None)


def test_attributes_are_read_one_by_one():
    for attributes in ('href="/the-hidden-lake"', 'title="The hidden valley"', 'data-hidden="false"', 'href="/x?role=search"', "title='a class=ad b'", "href=/hidden", 'data-class="ad"'):
        assert html_text.main_text(f"<article><p>One, two.</p><p><span {attributes}>Three.</span></p></article>") == "One, two.\n\nThree.", attributes
    for attributes in ("hidden", "HIDDEN=''", 'title="x" hidden', 'role = "search"', "class=ad", "href=/x id='comments'", 'aria-hidden="true"', 'style="display: none"'):
        assert html_text.main_text(f"<article><p>One, two.</p><p><span {attributes}>Three.</span></p></article>") == "One, two.", attributes


def test_all_content_of_a_page_is_returned():
    long, short = "Text, and more. " * 60, "A second article, of its own. " * 5
    assert html_text.main_text(f"<main><article><p>{long}</p></article><article><p>{short}</p></article></main>") == f"{long.strip()}\n\n{short.strip()}"
    assert html_text.main_text(f"<body><div><p>{short}</p></div><div><p>{long}</p><p>{long}</p></div></body>") == "\n\n".join([short.strip(), long.strip(), long.strip()])
    linked = "One, two, <a href=/x>three, four, five, six, seven.</a>"
    assert "seven." in html_text.main_text(f"<body><div><p>{long}</p><p>{linked}</p><p>{long}</p></div></body>")
