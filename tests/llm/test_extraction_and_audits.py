"""Resampling, main text of pages and the divergence of sources: against SQL, plain versions and known answers."""

import glob
import hashlib
import html
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "Ünder the ÜNDER the 12 x", "en", "a"), (3, "Ünder the ÜNDER the 12 x", "en", "a"), (4, "the the\nTHE cat's naïve" * 40, "en", "b"),
    (None, "the sky " * 30, "en", "b"), (5, "0 1 2 _ !", "", None), (6, "word " * 5000, "de", "c"), (7, "a b", "de", "d"),
]


def plain(v):
    return "null" if v is None or v != v else v


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lg, s, 1.5, 7) for i, t, lg, s in ODD], "doc_id long, text string, lang string, source string, row double, bucket int").repartition(3)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_source_divergence"])
def test_query_matches_sql(spark, name):
    from spanforge.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*want.columns).collect()]
    assert len(rows) > 100 and sorted(rows, key=str) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def plain_resampling(docs, target, longest, buckets, least, percent, seed):
    def features(text):
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features(x))
        out.append([i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    ranks = [k + 1 if k < percent * len(able) // 100 else "null" for k in range(len(able))]
    return sorted([tuple(map(plain, r)) + (k,) for r, k in zip(able, ranks, strict=True)] + [tuple(map(plain, r)) + ("null",) for r in out if r[1] < least], key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_odd_texts(spark, odd, longest, monkeypatch):
    from spanforge.llm import importance

    monkeypatch.setattr(importance, "BLOCK_CHARS", 300)
    target = ["The sky", None, "12 cats"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(odd, wanted, longest, 50, 4, 60, 9)
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=str) == plain_resampling([r[:2] for r in ODD], target, longest, 50, 4, 60, 9)
    assert importance.resample(odd.where("false"), wanted, longest).count() == 0
    assert importance.resample(odd, wanted.where("false")).count() == len(ODD)


def plain_divergence(docs, least, top):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in df[lang].items() if n >= least]
        v = len(kept)

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (count[w] + 5) // (total + 5 * v) for w in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "parts"), [(1, 50, 64), (2, 2, 1), (100, 5, 3)])
def test_divergence_of_odd_rows(odd, least, top, parts):
    from spanforge.llm.divergence import divergence

    rng = random.Random(4)
    more = [(None, " ".join(rng.choices("ab cd ef ß é".split(), k=rng.randint(0, 9))), rng.choice(["en", "xx"]), f"s{rng.randint(0, 4)}") for _ in range(60)]
    docs = odd.unionByName(odd.sparkSession.createDataFrame([(*r, 0.0, 0) for r in more], odd.schema))
    assert sorted(map(tuple, divergence(docs, least, top, parts).collect())) == plain_divergence(ODD + more, least, top)
    assert divergence(docs.where("false")).count() == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from spanforge.llm.divergence import _share

    n, total, terms = 10**13, 10**15 + 7, 123456
    got = spark.range(1).select(_share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def plain_article(page):
    """The text between the tags of the one article that each given page has."""
    inside = page[page.index("<article>") + 9 :]
    blocks = re.split(r"</?(?:p|h1)>", inside[: inside.index("</article>")])
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def test_main_text_of_all_given_pages(spark):
    from spanforge.llm.html_extract import op12_html_extraction

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op12_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


ARTICLE = "<h1>Title &amp; more</h1><p>First   paragraph, with commas,<br>and <b>bold</b> text&hellip;<p>Short.<ul><li>one<li>two</ul>"
TEXT = "Title & more\nFirst paragraph, with commas, and bold text…\nShort.\none\ntwo"
CHATTER = "<p>Very, very, very, long, talk, with, many, commas, " + "and words " * 60 + "</p>"
LAYOUTS = [
    "<article>{a}</article>",
    "<nav><ul><li><a href=x>Menu</a></ul></nav><header><h1>Site</h1>{c}</header><main><article>{a}<footer>{c}</footer></article></main><aside>{c}</aside><footer>{c}</footer>",
    "<div class='post-content'>{a}</div><div id=comments><h3>Replies</h3>{c}</div><div class='sideBar'>{c}</div>",
    "<div class='layout has-sidebar no-comments'><div class=content>{a}<div class='ad-slot'>{c}</div><form>{c}</form></div><div class=sidebar>{c}</div></div>",
    "<form id=all><div class='cookie-notice'>{c}</div><article class='post comments-open'>{a}<section class=comments><article>{c}</article></section></article></form>",
    "<article><header><p>by someone</p>{h}</header>{b}<article>{c}</article></article>",
    "<div role=navigation>{c}</div><div role='main'>{a}</div><div role=complementary>{c}</div><div hidden>{c}</div><div style='display: none'>{c}</div>",
    "<script>if (a<b) document.write('<p>{c}</p>')</script><style>p{{}}</style><!-- {c} --><article>{a}<noscript>{c}</noscript><template>{c}</template></article><textarea>{c}</textarea>",
    "<section class='related-posts'><article>{c}</article></section><article>{a}<ul><li><a href=1>one link</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>",
    "<table><tr><td class=menu>{c}<td><div id=main>{a}</div></table>",
    "<body class='page no-js ads'><div><div id='content'>{a}<button><p>Share</button></div></div><div class=copyright>{c}</div>",
    "<ARTICLE CLASS=post DATA-X='a>b'>{a}</ARTICLE><div class=newsletter>{c}</div>",
    "<article>{a}</article><footer>{c}",
    "<article>{a}</article><!-- {c}",
    "<article>{a}</article><div class='unfinished",
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_main_text_of_layouts(k):
    from spanforge.llm.html_extract import main_text

    heading, body = ARTICLE.split("</h1>")
    page = "<!doctype html><html><head><title>No</title></head>" + LAYOUTS[k].format(a=ARTICLE, b=body, h=heading + "</h1>", c=CHATTER)
    assert main_text(page) == TEXT


def test_main_text_without_telling_names():
    from spanforge.llm.html_extract import main_text

    body = "".join(f"<p>Paragraph {k}, as it is, goes on and on for quite some time, so it counts.</p>" for k in range(6))
    links = "".join(f"<li><a href=/{k}>some page of ours, {k}</a></li>" for k in range(30))
    want = "\n".join(f"Paragraph {k}, as it is, goes on and on for quite some time, so it counts." for k in range(6))
    assert main_text(f"<div><ul>{links}</ul></div><div><h1>Head</h1><div>{body}</div></div><div>Short note.</div>") == f"Head\n{want}"
    assert main_text(f"<div>{links}</div><div>{body}</div><div>{body}</div>") == f"{want}\n{want}"
    assert main_text("just text, a < b & c") == "just text, a < b & c"
    assert main_text("") == main_text("<p></p>") == ""
    assert main_text("<h1>Only a head</h1>") == "Only a head"
    assert main_text("<p>&#x41;&eacute;&nbsp;&am &amp") == "Aé &am &"


@pytest.mark.parametrize(
    "bomb",
    ["<div>" * 50_000 + "x", "<b>" * 50_000 + "<p>x" * 20_000, '<a href="x' * 30_000, "<ul><li><b>" * 20_000, "<!--" * 50_000, "<" * 100_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000,
     "<script>" * 20_000, "<p title='" * 20_000, "<td>" * 20_000 + "<tr>" * 20_000, "<p>a<ul>" * 20_000 + "</ul>" * 20_000],
)
def test_main_text_takes_linear_time(bomb):
    from spanforge.llm.html_extract import main_text

    began = time.process_time()
    main_text(bomb)
    assert time.process_time() - began < 5


def test_extract_odd_tables(spark):
    from spanforge.llm.html_extract import extract

    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>x</p>", 3), (1, "u", "<p>x</p>", 3), (2, None, f"<article><p>{'long words ' * 50_000}</p></article>", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = sorted((tuple(map(plain, (r.page_id, r.url, r.text))) for r in extract(pages).collect()), key=str)
    assert got == sorted([("null", "null", ""), (1, "u", ""), (1, "u", "x"), (1, "u", "x"), (2, "null", ("long words " * 50_000).strip())], key=str)
    assert extract(pages.where("false")).count() == 0
