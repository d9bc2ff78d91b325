import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import html, warc

ARTICLE = "This paragraph of the article is long enough to stand out from links."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain text", "plain text"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>{ARTICLE}<p>Short.</article><footer>f</footer>", f"T & t\n{ARTICLE}\nShort."),
        (f"<body class=has-sidebar><div id=menu><ul><li><a href=a>a</a></ul></div><div class=content><p>{ARTICLE}</p><p>b\n  c</p></div><div class='user-comments'><p>{ARTICLE}</p></div>", f"{ARTICLE}\nb c"),
        (f"<main><article><header><h1>Top</h1><p>by me</p></header><p>{ARTICLE}</p><aside>x</aside><form><p>f</p></form></article><article class=related>{ARTICLE * 3}</article></main>", f"Top\n{ARTICLE}"),
        (f"<article><p>{ARTICLE}</p><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><div class=ad>buy</div><div role=alert>!</div><div style='display: none'>h</div><p>z</p></article>", f"{ARTICLE}\nz"),
        (f"<article><div class=post-header><h2>T</h2><span>by</span></div><p>{ARTICLE}</article>", f"T\n{ARTICLE}"),
        (f"<div class=header><h1>Site</h1></div><article><p>{ARTICLE}</article>", ARTICLE),
        (f"<article><p><b>{ARTICLE}<br><p>next</p></article>", f"{ARTICLE}\nnext"),
        (f"<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><p>{ARTICLE}</article>", f"a\nb\nc\nx\ny\n{ARTICLE}"),
        (f"<article><p>{ARTICLE}</p></p></div></article></body>", ARTICLE),
        (f"<article>{ARTICLE}&nbsp;&#233;&lt;b&gt;", f"{ARTICLE} é<b>"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = " ".join([ARTICLE] * 8)


@pytest.mark.parametrize(
    "page,text",
    [
        # names around most of the content
        (f"<nav><a href=x>Home</a></nav><article class='post category-social'><h1>T</h1><p>{LONG}</p><div class=ad>buy</div></article><footer>f</footer>", f"T\n{LONG}"),
        (f"<div class='with-sidebar page-widget'><article><p>{LONG}</p></article></div><p>x</p>", LONG),
        (f"<form action=x><div id=related-wrap><div class=content><p>{LONG}</p><p>b</p></div></div></form>", f"{LONG}\nb"),
        (f"<div class=header><article><p>{LONG}</p></article></div>", LONG),
        # several articles, and content outside of a small one
        (f"<article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG} more</p></article><article><p>card</p></article>", f"A\n{LONG}\nB\n{LONG} more"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>{ARTICLE}</p></article>", f"{LONG}\n{LONG}\n{ARTICLE}"),
        # what is hidden, or no text, stays out however long
        (f"<div hidden><p>{LONG}</p></div><nav>{LONG}</nav><article class=x><p>{ARTICLE}</p></article>", ARTICLE),
    ],
)
def test_content_selects_regions(page, text):
    assert html.main_text(page) == text


def test_extract_rows(spark):
    rows = [(1, "u", f"<article><p>{ARTICLE}é</p></article>", 1), (1, "u", None, 2), (None, None, "<p>" + "long " * 50_000 + "</p>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.n_chars: r for r in html.extract(pages).collect()}
    assert got[0].text == "" and got[len(ARTICLE) + 1].text == ARTICLE + "é" and len(got) == 3
    assert max(got) == len(("long " * 50_000).strip())
    assert html.extract(pages.where("false")).count() == 0


def pages_of(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" + "x" * 200_000 + "é</p>"
    rows = [(1, "http://a\r\nX: y", big), (2, "http://b", big), (9, None, big), (3, "c", "small"), (4, "d", "small"), (5, "e", None), (6, "f", ""), (None, "g", big), (7, "h", "a" * 999), (8, "i", "a" * 999), (10, "j", "b" * 1000), (11, "k", "b" * 1000)]
    return rows, spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, last int")


def test_round_trip(spark):
    rows, pages = pages_of(spark)
    archives = warc.write_archives(warc.dedup_plan(pages.repartition(3)), archive_bytes=150_000)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[2] for x in rows if x[0] == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
    assert {r.page_id: (r.record_type, r.refers_to) for r in got if r.record_type == "revisit"} == {1: ("revisit", 9), 2: ("revisit", 9), 10: ("revisit", 11)}
    chunks = warc.read_archives(archives, chunks=True)
    assert chunks.agg(F.max(F.length("data"))).first()[0] == warc.CHUNK
    whole = {}
    for r in chunks.orderBy("record_id", "chunk").collect():
        whole[r.record_id] = whole.get(r.record_id, b"") + bytes(r.data)
    assert whole[warc.record_uuid(9)].decode() == rows[0][2]
    none = warc.write_archives(warc.dedup_plan(pages.where("false")))
    assert warc.read_archives(none).count() == 0


def test_files_and_broken_archives(spark, tmp_path):
    _, pages = pages_of(spark)
    archives = warc.write_archives(warc.dedup_plan(pages.repartition(2)))
    done = warc.export_files(archives, f"file://{tmp_path}/out").collect()
    for r in done:
        data = (tmp_path / "out" / f"{r.archive}.warc").read_bytes()
        assert len(data) == r.bytes and data.startswith(b"WARC/1.1\r\n")
    reader = warc.Reader()
    events = [e for i in range(0, len(data), 777) for e in reader.feed(data[i : i + 777])]
    reader.close()
    assert sum(e[0] == "end" for e in events) == data.count(b"WARC-Record-ID")
    cut = warc.Reader()
    list(cut.feed(data[:-50_000] if len(data) > 60_000 else data[:-10]))
    with pytest.raises(ValueError):
        cut.close()
    with pytest.raises(ValueError):
        list(warc.Reader().feed(b"nonsense\r\n\r\n"))


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a<![foo[b]]>c</p>", "ac"),
        ("<![foo[x", "<![foo[x"),
        ("x<!['y", "x<!['y"),
        ("<p>a <label>no</label> b <button>no</button> c<script>no</script></p>", "a b c"),
        ("&#" + "9" * 5000 + ";x &#" + "0" * 5000 + "65;", "�x A"),
        ("<p>x</p><a href='", "x\n<a href='"),
    ],
)
def test_broken_markup(page, text):
    assert html.main_text(page) == text


def test_mutated_pages_are_read():
    import random

    rng = random.Random(11)
    whole = f"<html><body class='x y'><nav><a href=a>a</a></nav><article><h1>T &amp; t</h1><p>{LONG}<p>b &#233; <!-- c --><label>l</label></article><script>var x;</script><footer>f</footer></body></html>"
    bits = ["<![", "]]>", "<!--", "-->", "&#", "&#x", "<", "</", ">", "'", '"', "<svg>", "</label>", "<p", "<article>", "</article>", "\x00", "<!DOCTYPE [", "<?x", "<![if", "<title>"]
    for _ in range(10_000):
        page = whole
        for _ in range(rng.randint(1, 10)):
            i = rng.randrange(len(page) + 1)
            page = page[:i] + rng.choice(bits) + page[i + rng.randint(0, 20) :]
        assert isinstance(html.main_text(page), str)


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 50_000, "<!--" * 50_000, "<!-- >" * 30_000, "<![CDATA[>" * 20_000, "<title>" * 20_000 + "</x>" * 20_000, "<a '" * 30_000 + ">", "<div>" * 50_000):
        start = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - start < 5, page[:9]


def brute_content(blocks):
    """The lines whose smoothed text-to-tag ratio reaches the ratios' spread, by loops."""
    import math

    ratio = [(len(text) - links) / max(1, tags) for text, tags, links, *_ in blocks]
    weight = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
    level = [sum(w * ratio[min(max(i + d, 0), len(ratio) - 1)] for w, d in zip(weight, range(-3, 4))) / sum(weight) for i in range(len(ratio))]
    mean = sum(level) / len(level)
    spread = math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    return [x >= min(spread, max(level)) - 1e-9 for x in level]


def test_clusters_match_brute_force():
    import random

    rng = random.Random(12)
    for _ in range(300):
        blocks = [["x" * rng.choice([3, 20, 300]), rng.randint(0, 9), 0] for _ in range(rng.randint(1, 40))]
        for b in blocks:
            b[2] = rng.choice([0, 0, len(b[0])])
        assert html.content_blocks(blocks).tolist() == brute_content(blocks)


def test_chunk_rows_carry_digests(spark):
    rows, pages = pages_of(spark)
    archives = warc.write_archives(warc.dedup_plan(pages.repartition(2)))
    held = {}
    for r in archives.orderBy("archive", "record", "chunk").collect():
        held.setdefault((r.archive, r.record), []).append(r)
    assert len(held) == len(rows)
    for chunks in held.values():
        assert [c.chunk for c in chunks] == list(range(len(chunks))) and all(len(c.data) <= warc.CHUNK for c in chunks[1:])
        payload = b"".join(bytes(c.data) for c in chunks[1:-1])
        assert [c["size"] for c in chunks[:-1]] == [sum(len(x.data) for x in chunks[1 : k + 1]) for k in range(len(chunks) - 1)]
        assert all(c.sha1 is None for c in chunks[:-1])
        if b"WARC-Type: response" in bytes(chunks[0].data):
            assert chunks[-1].sha1 == hashlib.sha1(payload).hexdigest()
        else:
            assert chunks[-1].sha1 is None and not payload
    twice = spark.createDataFrame([(1, "u", "z" * 2000), (1, "u", "z" * 2000), (None, "v", "z" * 2000)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.dedup_plan(twice))).collect()
    assert [(r.record_type, r.refers_to) for r in got] == [("response", None)] * 3
