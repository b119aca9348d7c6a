"""The methods where they act: tables on which lines go, links carry mass, paths are selected and tables start anew, against brute force."""

import hashlib
import random
import re
import time
from collections import defaultdict

import duckdb
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from conftest import SMALL, rows

from wordloom.llm import bpe_transducer, bpe_vocabulary, decontaminate, html_text, quality_rules, token_counts, url_trust

TEXTS = [t or "" for t in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column("text").to_pylist()]


def brute_lines(docs):
    """id to (removed words, kept) of (id, text, source), by the rules' own words."""
    lines = {i: [x for x in (re.sub("[\t\x0b\x0c\r ]+", " ", y).strip(" ") for y in t.lower().split("\n")) if x] for i, t, _ in docs}
    having, hosts = defaultdict(set), defaultdict(int)
    for i, _, s in docs:
        hosts[s] += bool(lines[i])
        for line in lines[i]:
            having[s, line].add(i)
    hot = set()
    for (s, line), ids in having.items():
        kinds = {frozenset(lines[i]) for i in ids}
        if len(ids) >= quality_rules.MIN_DOCS and len(ids) >= quality_rules.MIN_SHARE * hosts[s] and len(kinds) >= quality_rules.MIN_VARIETY * len(ids):
            hot.add((s, line))
    out = {}
    for i, t, s in docs:
        words = t.split()
        removed = sum(len(line.split()) for line in lines[i] if (s, line) in hot)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        out[i] = (removed, not failed and removed <= quality_rules.MOST * len(words))
    return out


def boilerplate():
    r = random.Random(3)
    own = lambda n: [" ".join(f"w{r.randrange(10**6)}" for _ in range(9)) for _ in range(n)]
    shared = {s: own(8) for s in "abc"}
    docs = []
    for i in range(120):
        s = "abc"[i % 3]
        text = [*own(r.randrange(3, 12)), *r.sample(shared[s], r.randrange(9))]
        r.shuffle(text)
        docs.append((i, "\n".join(x.upper() if r.random() < 0.1 else x + " " for x in text), s))
    same = "\n".join(own(8))
    return docs + [(1000 + k, same, "a") for k in range(60)] + [(2000 + k, f"{same}\nthe {k}", None) for k in range(5)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_of_hosts(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", -1)
    docs = boilerplate()
    want = brute_lines(docs)
    found = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.n_removed_words, r.kept) for r in found} == want
    assert sum(n > 0 for n, _ in want.values()) > 50 and sum(n > 0 and not kept for n, kept in want.values()) > 5
    kept = {r.doc_id: r.text for r in quality_rules.cleaned(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert set(kept) == {i for i, (_, k) in want.items() if k}
    assert all(len(t.split()) - len(kept[i].split()) == want[i][0] for i, t, _ in docs if i in kept)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(docs, "doc_id long, text string, source string").where("source IS NOT NULL").toArrow())
    assert {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_removed_words, kept FROM ({quality_rules.SQL})").fetchall()} == {i: w for i, w in want.items() if i < 2000}


def host_graph():
    r = random.Random(4)
    hosts = [f"h{k}.biz" for k in range(40)] + ["bad.net", "worse.net", "x.example.com", "y.org", "z.org", "w.example.com"]
    pages = []
    for i in range(220):
        host = r.choice(hosts)
        path = r.choice(["/", "/fr/a", "/de/b", "/en/c?d=/de/", ""])
        links = "".join(f'<a href="{r.choice(["http:", "https:", ""])}//{r.choice(hosts).upper() if r.random() < 0.1 else r.choice(hosts)}/p">x</a>' for _ in range(r.randrange(5)))
        pages.append((i, f"http://{host}{path}", links))
    for i, (host, path) in enumerate([("y.org", "/fr/a"), ("z.org", "/fr/b"), ("z.org", "/"), ("x.example.com", "/de/a"), ("x.example.com", "/"), ("x.example.com", "/"), ("bad.net", "/")]):
        pages.append((300 + i, f"http://{host}{path}", "".join(f"<a href=//h{r.randrange(40)}.biz/p>x</a>" for _ in range(3))))
    return pages


def brute_mass(pages):
    """(kind, host) to its share of all mass, by a hundred rounds over all edges, with what a whole seed starts with."""
    host_of = lambda url: url.split("://")[1].split("/")[0].lower()
    verdicts, every, edges = defaultdict(lambda: defaultdict(int)), defaultdict(int), {"trust": defaultdict(set), "distrust": defaultdict(set)}
    for _, url, html in pages:
        host, path = host_of(url), "/" + url.split("://")[1].partition("/")[2].split("?")[0] if "/" in url.split("://")[1] else ""
        fit = [(len(h + p), says) for h, p, says in url_trust.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        every[host] += 1
        if fit:
            verdicts[{"allow": "trust", "block": "distrust"}[max(fit)[1]]][host] += 1
        for dst in re.findall(r"//([^/]+)/p", html):
            if dst.lower() != host:
                edges["trust"][host].add(dst.lower())
                edges["distrust"][dst.lower()].add(host)
    out, whole = {}, {}
    for kind in edges:
        share = {h: n / every[h] for h, n in verdicts[kind].items()}
        total = sum(share.values())
        start = {h: 0.15 * s / total for h, s in share.items()}
        whole[kind] = 0.15 / total
        mass = dict(start)
        for _ in range(200):
            new = defaultdict(float, start)
            for h, m in mass.items():
                for dst in edges[kind][h]:
                    new[dst] += 0.85 * m / len(edges[kind][h])
            mass = new
        for h, m in mass.items():
            out[kind, h] = m - (start.get(h, 0) if share.get(h, 0) <= 0.5 else 0)
    return out, whole


@pytest.mark.parametrize("broadcast", [True, False])
def test_mass_over_links(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_trust, "BROADCAST_ROWS", -1)
    pages = host_graph()
    want, whole = brute_mass(pages)
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = url_trust.judge(table).collect()
    reached = 0
    for r in found:
        for kind, got in (("trust", r.trust), ("distrust", r.distrust)):
            mass = want.get((kind, r.host), 0)
            assert abs((got or 0) / url_trust.UNITS - mass) <= 1e-3 * whole[kind] + 1e-9, (r.host, kind)
        distrust, trust = want.get(("distrust", r.host), 0), want.get(("trust", r.host), 0)
        if r.rule is None and abs(distrust - trust) > 1e-3 * max(whole.values()):
            assert r.verdict == ("block" if distrust > trust and distrust >= whole["distrust"] / url_trust.FEW else "allow")
            reached += r.verdict == "block"
    assert reached > 10
    con = duckdb.connect()
    con.register("pages", table.toArrow())
    assert rows(url_trust.judge(table).toArrow()) == rows(con.sql(url_trust.SQL).to_arrow_table())


LONG, SHORT = "Text, and more of it, follows here. " * 20, "A second article, of its own. " * 5
TEMPLATES = {
    "article in a div": ("<body><div class=top><a href=/>Home</a> <a href=/b>News</a></div><div id=content><h1>Head</h1><p>{L}</p><ul><li>one item</li><li>two items</li></ul><h2>More</h2><p>{L}</p></div><div class=foot>© 2024 Company. All rights reserved.</div><div class=comments><p>{L}</p></div></body>", "Head|{L}|one item|two items|More|{L}"),
    "article tag": ("<nav><a href=/>x</a></nav><article><h1>Hi</h1><p>{L}</p><ul><li>a</li><li>b</li></ul><p>ok</p></article><p>Loose, loud text.</p><footer>{S}</footer>", "Hi|{L}|a|b|ok"),
    "names that only look like hints": ("<body><div class='social-science side-by-side'><p>{L}</p></div><div class=share-bar>Share this now</div></body>", "{L}"),
    "a hint around everything": ("<body><div class=widget><p>{L}</p><p>{S}</p></div></body>", "{L}|{S}"),
    "two articles": ("<main><article><p>{L}</p></article><article><p>{S}</p></article></main>", "{L}|{S}"),
    "aside and form": ("<body><div><p>{L}</p><form><p>{S}</p></form><p>{L}</p></div><aside>{S}</aside></body>", "{L}|{L}"),
    "an article's own heading": ("<header><p>{S}</p></header><article><header><h1>Head</h1></header><p>{L}</p><footer><p>{S}</p></footer></article>", "Head|{L}"),
    "names with words around": ("<body><div class='cookie-notice'>{S}</div><div><p>{L}</p><p>{L}</p></div><div class='related-posts'><p>{S}</p></div><div id=main-nav><p>{S}</p></div><div class='x reader-comments'><p>{S}</p></div></body>", "{L}|{L}"),
    "a head that is not closed": ("<html><head><title>T</title><body><article><p>{L}</p></article></body>", "{L}"),
    "comments that end where they begin": ("<!--><article><p>{L}</p><!---><p>Two, more.</p><!-- gone --></article>", "{L}|Two, more."),
    "a formula in a sentence": ("<article><p>{L}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", "{L}|So x=2 holds."),
    "references that are links": ("<article><p>{L}</p><h2>References</h2><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></article>", "{L}|References|One|Two"),
    "words that only contain a hint": ("<article><p>{L}</p>" + "".join(f"<div {a}><p>Kept, too.</p></div>" for a in ("class=market-share", "class=health-related", "class=job-alert", "class=side", "class=social", "id=dinner-menu")) + "<div class=share-bar><p>Gone, though.</p></div></article>", "{L}" + "|Kept, too." * 6),
    "links inside text": ("<body><div><p>{L}</p><p>One, <a href=/x>two, three</a>, four.</p><p>{L}</p></div></body>", "{L}|One, two, three, four.|{L}"),
}


def test_templates():
    fill = lambda x: x.replace("{L}", LONG).replace("{S}", SHORT)
    for name, (page, want) in TEMPLATES.items():
        want = "\n\n".join(fill(x).strip() for x in want.split("|"))
        assert html_text.main_text(fill(page)) == want, name
    page = fill("<body><div><p>{S}</p></div><div><p>{L}</p><p>{L}</p></div></body>")
    assert html_text.main_text(page).startswith(SHORT.strip()) and not html_text.main_text(page, 3.0).startswith(SHORT.strip())


def test_paths_decide():
    pages = [h for h in pq.read_table(f"{SMALL}/pages.parquet", columns=["html"]).column("html").to_pylist() if h]
    bare = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", re.sub(' (?:class|id)="[^"]*"', "", h)) for h in pages]
    found = [html_text.main_text(h) for h in pages]
    assert sum(html_text.main_text(h, 0.0) != t for h, t in zip(pages, found, strict=True)) > 0.9 * len(pages)
    assert sum(html_text.main_text(h) == t for h, t in zip(bare, found, strict=True)) > 0.8 * len(pages)


def test_pages_of_any_shape_take_linear_time():
    for page in ("<a b" * 100_000, "<div>" * 50_000 + "x", '<a x="' * 50_000, '<a x=">' * 50_000, "<p><b>" * 30_000 + "</i>" * 30_000, "<ul><li>a" * 20_000, "</p>" * 50_000, "<!--" * 50_000, "İ<script>" * 20_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 5, page[:10]


def test_tables_that_start_anew(monkeypatch):
    """The transducer's states, and the pieces that are remembered, may be forgotten at any time."""
    monkeypatch.setattr(bpe_transducer, "KEPT_STATES", 500)
    monkeypatch.setattr(bpe_transducer, "KEPT_PIECES", 50)
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 50)
    path = P.path("byte_bpe_50k.tiktoken")
    import numpy as np
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_vocabulary.load_ranks(path), special_tokens={})
    codec = bpe_transducer.Codec(bpe_vocabulary.from_ranks(path), P.PATTERN)
    counts = token_counts.PrefixCounts(*bpe_vocabulary.from_json(P.path("byte_bpe_50k.json")), P.PATTERN)
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in TEXTS[:60]:
        ids = library.encode_ordinary(text)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
        assert b"".join(codec.decode(codec.encode(text))) == text.encode()
        every = counts.every_prefix(text)
        assert every[-1] == counts.of_text(text, 1024)[0] == len(other.encode(text, add_special_tokens=False).ids)


def test_every_prefix_of_a_piece():
    """Entry i of a piece's counts is the number of tokens of its first i bytes by themselves."""
    vocabulary, special = bpe_vocabulary.from_json(P.path("byte_bpe_50k.json"))
    counts = token_counts.PrefixCounts(vocabulary, special, P.PATTERN)
    for piece in {p for t in TEXTS[:20] for p in counts.pieces(t)}:
        data = piece.encode()
        assert list(counts[piece]) == [counts.prefix_counts(data[:k])[-1] for k in range(len(data) + 1)]


def test_utf8_in_any_cuts():
    r = random.Random(5)
    for k in range(3000):
        data = "".join(r.choice("aä€😀") for _ in range(20)).encode()[: r.randint(0, 60)] if k % 2 else bytes(r.choice([0x41, 0xC3, 0xA4, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xC0, 0xFF]) for _ in range(r.randint(0, 30)))
        machine, out, at = bpe_transducer.Utf8Machine(), "", 0
        while at < len(data):
            size = r.randint(1, 5)
            out += machine.feed(data[at : at + size])
            at += size
        out += machine.close()
        assert out == data.decode("utf-8", "replace") and machine.chars == len(out)


def test_benchmark_in_several_passes(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    found = [sorted((r.doc_id, r.n_words, r.hit, r.items, hashlib.md5((r.text or "").encode()).hexdigest()) for r in decontaminate.find(docs, bench, clean=True, pass_words=n).collect()) for n in (200_000, 200)]
    assert found[0] == found[1] and any(x[2] for x in found[0])
