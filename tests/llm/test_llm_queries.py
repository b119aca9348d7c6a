"""The queries of wordloom.llm: SQL twins, libraries, and brute force where SQL has no words for them."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from conftest import SMALL, rows

from wordloom.llm import near_dups
from wordloom.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL).toArrow()
    assert rows(found) == rows(duck.sql(ORACLES[name]).to_arrow_table())
    assert found.num_rows


def _documents():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = _documents()
    want = {k: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for k, t in texts.items()}
    found = QUERIES["op8_token_counts"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in found)


def _tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer(spark):
    library = _tiktoken()
    want = {}
    for k, t in _documents().items():
        ids = library.encode_ordinary(t)
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    found = QUERIES["op9_bpe_transducer"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want


def brute_bytes(texts, size=100):
    """doc_id to (bytes, removed, spans, kept)."""
    seen, out = set(), {}
    for k in sorted(texts):
        data, gone = texts[k].encode(), [False] * len(texts[k].encode())
        for i in range(len(data) - size + 1):
            if data[i : i + size] in seen:
                gone[i : i + size] = [True] * size
            seen.add(data[i : i + size])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def test_suffix_dedup(spark):
    want = {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in brute_bytes(_documents()).items()}
    found = QUERIES["op7_suffix_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want


def test_html(spark):
    from wordloom.llm.html_text import main_text

    page = "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy.</div><article><h1>Head &amp; line</h1><p>One, two.<p>Three   four,\nfive.<div class='comments'><p>Nice!</p></div></article><footer>&copy; me</footer></body></html>"
    assert main_text(page) == "Head & line\n\nOne, two.\n\nThree four, five."
    assert main_text(None) == main_text("") == ""
    found = QUERIES["op10_html_text"](spark, SMALL).collect()
    assert len(found) == pq.read_metadata(f"{SMALL}/pages.parquet").num_rows and all(r.n_chars == len(r.text) for r in found)


def test_pipeline(spark):
    """Each stage on its own input, the first four by the SQL of their operators and the last by the library."""
    import corpus_pipeline
    from conftest import duck_over

    from wordloom.llm.common import written

    docs, library = spark.read.parquet(f"{SMALL}/documents.parquet"), _tiktoken()
    columns = docs.columns
    sql = {"quality rules": ORACLES["op1_quality_rules"], "near duplicates": near_dups.sql(80), "substring dedup": ORACLES["op5_substring_dedup"], "decontamination": ORACLES["op4_decontaminate"]}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL), "stage")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name in sql:
            assert out.columns == columns
            con = duck_over(SMALL, ["benchmark"])
            table = docs.toArrow()
            con.register("documents", table)
            judged = {r[0]: r for r in con.sql(f"SELECT * FROM ({sql[name]})").fetchall()}
            names = [d[0] for d in con.sql(f"SELECT * FROM ({sql[name]}) LIMIT 0").description]
            judged = {k: dict(zip(names, v, strict=True)) for k, v in judged.items()}
            kept = {k for k, j in judged.items() if j.get("kept", True) and j.get("n_hit", 0) <= 0.5 * j.get("n_words", 0) or "n_removed" in j}
            assert set(after) == kept
            assert all(r.n_chars == len(r.text) for r in after.values()) or name == "near duplicates"
            for k, r in after.items():
                if name == "substring dedup":
                    assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == judged[k]["kept_sha256"]
                elif judged[k].get("n_removed_words", 0) == 0 and judged[k].get("n_hit", 0) == 0:
                    assert r.text == before[k].text
                else:
                    assert len(r.text) < len(before[k].text)
        else:
            assert {k: np.frombuffer(r.ids, "<u4").tolist() for k, r in after.items()} == {k: library.encode_ordinary(r.text) for k, r in before.items()}
            assert all(bytes(r.decoded).decode() == before[k].text for k, r in after.items())
        docs = out


def test_bytes_within_limit():
    from wordloom.llm.token_counts import counts_of

    counts = counts_of(P.path("byte_bpe_50k.json"), P.PATTERN)
    cut = 0
    for text in [*list(_documents().values())[:60], "", "a", "é" * 40, "word " * 30]:
        prefixes = counts.every_prefix(text)
        for limit in (0, 1, 7, 50, 10_000):
            n_tokens, within = counts.of_text(text, limit)
            assert n_tokens == prefixes[-1] and within == max(k for k, n in enumerate(prefixes) if n <= limit), (text[:40], limit)
            cut += within < len(prefixes) - 1
    assert cut > 100
