"""Page extraction, URL verdicts and archives."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import struct
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from shortlist.llm import extraction, url_filter, warc
from shortlist.llm.queries import QUERIES, URL_RULES

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"
    "<nav><a href=/>Home</a></nav><header>Site</header><div class='sidebar'><p>Other, news.</p>"
    "</div><article><header><h1>Head&amp;line</h1></header><p>First, with  <b>bold</b>\n text.<br>"
    "<p>Second &lt;para&gt;, &eacute;.<script>x</script></p><ul><li>one<li>two</ul>"
    "<form>Search <input></form><p>Third.</p><div class=comments><p>I, reader, disagree.</p></div>"
    "</article><footer>&copy; 2024</footer></body></html>"
)


@pytest.mark.parametrize(
    "html, text",
    [
        (PAGE, "Head&line\nFirst, with bold text.\nSecond <para>, é.\none\ntwo\nThird."),
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\nb"),
        ("<nav>menu</nav>", ""),
        ("<p>x</p><!-- open <p>y", "x"),
        ("a < b and c <3", "a < b and c <3"),
        ('<p class="x>open quote <p>text', "open quote\ntext"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<article>cut off <p>here and</p", "cut off\nhere and"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ],
)
def test_main_text(html, text):
    assert extraction.main_text(html or "") == text


def test_links_cost_points_and_good_siblings_stay():
    links = "".join(f"<p><a href=/{i}>Some, linked, words {i}</a></p>" for i in range(9))
    body = "<p>A real, long, well made sentence about things that matter here.</p>" * 2
    html = f"<div>{links}</div><section><div>{body}</div><div>{body}</div></section>"
    text = extraction.main_text(html)
    assert "linked" not in text and text.count("A real") == 4


def test_extract_keeps_other_columns(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(pages, "html")
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(r.text[:4] for r in got.collect()) == ["", "Head", "Head"]
    assert extraction.extract(pages.limit(0), "html").count() == 0


def test_extraction_of_the_given_pages(spark):
    import html as markup

    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for row in QUERIES["op7_extract_pages"](spark, folder).collect():
        article = re.search(r"(?s)<article>(.*?)(</article>|<[^>]*$|\Z)", pages[row.page_id])[1]
        blocks = [" ".join(markup.unescape(re.sub(r"</?b>|<br>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)


# -- URLs ----------------------------------------------------------------------------------

URLS = [
    ("HTTP://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://example.org/en/21", "example.org", "/en/21", "org/"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
    ("http://x.com/fr/#a", "x.com", "/fr/", "com/fr/"),
    ("http://x.com/frx", "x.com", "/frx", None),
    ("http://com/de/1", "com", "/de/1", "com/de/"),
    ("http://org", "org", "", None),
    ("ftp://h?x/org/", "h", "", None),
    ("a://b://org/", "b:", "//org/", None),
    ("no scheme org/", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
]


def test_rules(spark):
    rows = [(i, u[0], "a", "b", "c") for i, u in enumerate(URLS)]
    schema = "page_id long, url string, host string, _host string, _verdict string"
    df = spark.createDataFrame(rows, schema)
    verdicts = {r.text: r.verdict for r in URL_RULES}
    got = {r.page_id: r for r in url_filter.judge_urls(df, "url", URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdicts.get(rule, got[i].verdict) in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0), "url", URL_RULES).count() == 0


def _plain_scores(accepted, rejected, urls):
    """The smoothed models by dictionaries."""
    tables = []
    for group in (accepted, rejected):
        table = {}
        for u in group:
            data = bytes(url_filter.ORDER) + u.encode() + b"\x01"
            for i in range(url_filter.ORDER, len(data)):
                for k in range(url_filter.ORDER + 1):
                    context = data[i - k : i]
                    for key in ((context, k), (context, k, data[i])):
                        table[key] = table.get(key, 0) + 1
        tables.append(table)
    out = []
    for u in urls:
        data = bytes(url_filter.ORDER) + u.encode() + b"\x01"
        total = 0.0
        for sign, table in zip((1, -1), tables, strict=True):
            for i in range(url_filter.ORDER, len(data)):
                p = 1 / 257
                for k in range(url_filter.ORDER + 1):
                    context = data[i - k : i]
                    n, all_n = table.get((context, k, data[i]), 0), table.get((context, k), 0)
                    p = (n + url_filter.BACK_OFF * p) / (all_n + url_filter.BACK_OFF)
                total += sign * np.log(p)
        out.append(total / (len(u.encode()) + 1))
    return out


def test_scores_equal_plain_models(spark):
    good = [f"site{i % 7}.example.com/news/{i}" for i in range(60)]
    bad = [f"casino{i % 5}.example.net/win/{i}" for i in range(40)]
    rows = [(u, "allow") for u in good] + [(u, "block") for u in bad] + [("other", None)]
    df = spark.createDataFrame(rows, "u string, v string")
    judge = url_filter.fit(df, F.col("u"), F.col("v"))
    fold = F.pmod(F.xxhash64("u"), F.lit(url_filter.FOLDS))
    train = df.filter("v is not null").filter(fold != 0).collect()
    asked = ["site3.example.com/news/999", "casino2.example.net/win/7", "", "ü"]
    plain = _plain_scores([r.u for r in train if r.v == "allow"],
                          [r.u for r in train if r.v == "block"], asked)
    assert judge.scores(asked) == pytest.approx(plain, abs=1e-6)
    assert judge.scores(asked)[0] > judge.threshold > judge.scores(asked)[1]


def test_scores_of_many_grams(spark, monkeypatch):
    """More grams than travel with the tasks, and than a small hashed table could hold."""
    monkeypatch.setattr(url_filter, "COPIED", 1000, raising=False)
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    texts = ["".join(rng.choice(letters, 100)) for _ in range(4000)]
    rows = [(u, "allow" if i % 2 else "block") for i, u in enumerate(texts)]
    df = spark.createDataFrame(rows + [(texts[0], None), (None, None)], "u string, v string")
    judge = url_filter.fit(df, F.col("u"), F.col("v"))
    train = df.filter("v is not null").filter(
        F.pmod(F.xxhash64("u"), F.lit(url_filter.FOLDS)) != 0).collect()
    asked = [*texts[:20], "".join(rng.choice(letters, 100)), "", texts[0]]
    plain = _plain_scores([r.u for r in train if r.v == "allow"],
                          [r.u for r in train if r.v == "block"], asked)
    assert judge.scores(asked) == pytest.approx(plain, abs=1e-6)
    pages = df.select(F.concat(F.lit("http://"), "u").alias("url"), F.lit(1).alias("_one"))
    got = url_filter.judge_urls(pages, "url", [url_filter.Rule("none/", "allow")])
    assert got.count() == pages.count()


def test_models_read_the_whole_url(spark):
    good = [f"http://a.org/{i}?page={i}" for i in range(40)]
    bad = [f"https://a.com/{i}#win-casino" for i in range(40)]
    asked = ["http://b.net/7?page=1", "http://b.net/7#win-casino", "?page=22", "x#win-casino", None]
    rules = [url_filter.Rule("org/", "allow"), url_filter.Rule("com/", "block")]
    df = spark.createDataFrame([(u,) for u in good + bad + asked], "url string")
    got = {r.url: r for r in url_filter.judge_urls(df, "url", rules).collect()}
    assert all(got[u].rule is None for u in asked)
    assert [got[u].verdict for u in asked[:4]] == ["allow", "block", "allow", "block"]
    assert len({got[u].url_score for u in asked}) == 5


def test_threshold():
    assert url_filter._threshold([(-100, False, 5), (100, True, 5)]) == pytest.approx(0.0025, abs=0.01)
    assert url_filter._threshold([(3, True, 5)]) == 0.0
    low = url_filter._threshold([(-300, False, 9), (-200, True, 5), (50, True, 1)])
    assert -300 * url_filter.BIN < low <= -200 * url_filter.BIN


# -- archives ------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    bodies = ["", None, "same", "same", "é" * 100, "x" * 300_000]
    bodies += ["".join(rng.choice(list("abcd "), 400)) for _ in range(120)] + ["same"] * 50
    rows = [(i, None if i == 4 else f"http://h/{i}\r\nX: y", b, "c") for i, b in enumerate(bodies)]
    rows += [(None, "u", "same", "c"), (0, "again", "", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _payload string")
    folder = f"file://{tmp_path}/archives"
    files = warc.write_archives(df.repartition(3), folder, "page_id", "url", "html")
    records = warc.read_archives(spark, folder, files).withColumn("key", warc.key_of(F.col("record_id")))
    got = records.collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    last = max(i for i, b in enumerate(bodies) if b == "same")
    for r in got:
        body = "same" if r.key is None else (bodies[r.key] or "")
        data = body.encode()
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = {"same": last, "": 1}.get(body, r.key)
        if r.key == first:
            assert r.record_type == "response" and bytes(r.payload) == data
        else:
            assert r.record_type == "revisit" and r.refers_to == f"<urn:page:{first}>"
            assert r.payload is None
    assert warc.read_archives(spark, folder).count() == len(rows)
    empty = warc.write_archives(df.limit(0), f"{folder}-2", "page_id", "url", "html")
    assert empty.count() == 0


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i}") for i in range(64)]
    df = spark.createDataFrame(rows, "k long, u string, p string").repartition(16)
    folder = f"file://{tmp_path}/many"
    files = warc.write_archives(df, folder, "k", "u", "p")
    records = warc.read_archives(spark, folder, files)
    read = records.select("file", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.file for r in read}) == files.count() > 1
    assert len({r.task for r in read}) > 1


def test_least_bytes_of_a_revisit(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "k long, u string, p string")
    files = warc.write_archives(df, f"file://{tmp_path}/a", "k", "u", "p", least=3)
    records = warc.read_archives(spark, f"file://{tmp_path}/a", files)
    assert [r.record_type for r in records.collect()] == ["response"] * 2


def _frames(data):
    return list(warc.Frames(io.BytesIO(data)))


def test_dictionary_is_the_leading_frame():
    records = [warc.record_bytes(i, f"http://h/{i}", b"<p>some body</p>" * 40, None)
               for i in range(60)]
    dictionary = zstandard.train_dictionary(4096, records)
    packed = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=True)
    plain = dictionary.as_bytes()
    squeezed = zstandard.ZstdCompressor().compress(plain)
    body = b"".join(map(packed.compress, records))
    for lead in (plain, squeezed):
        head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(lead)) + lead
        assert [c for _, c, _ in _frames(head + body)] == records
    assert _frames(body)[0][1] is None  # the dictionary is needed
    cut = _frames(struct.pack("<II", warc.DICTIONARY_MAGIC, len(plain)) + plain + body[:-5])
    assert cut[-1][2] == "file ends inside a frame" and len(cut) == len(records)
    assert _frames(b"garbage!") == [(0, None, "no frame begins here")]
    assert _frames(b"") == []


def test_broken_records():
    good = warc.record_bytes(1, "u", b"body", None)
    assert warc.parse_record(good)["payload"] == b"body"
    cases = {
        good.replace(b"WARC/1.1", b"WARC/9"): "no WARC header",
        good.replace(b"WARC-Date: ", b"X-Date: "): "header WARC-Date is missing",
        good[:-1]: "Content-Length does not match the record",
        good.replace(b"body", b"bodi"): "payload does not match its digest",
        good.replace(b"Content-Length: 4", b"Content-Length: 5"):
            "HTTP Content-Length does not match the payload",
        good.replace(b"WARC-Type: ", b"WARC-Type "): "malformed header line",
    }
    for data, error in cases.items():
        assert warc.parse_record(data) == {"error": error}


# -- extraction: broken markup and depth ---------------------------------------------------


@pytest.mark.parametrize("tag", sorted(extraction.SKIPPED))
def test_unclosed_elements_do_not_swallow_the_page(tag):
    assert extraction.main_text(f"<p>A one.</p><{tag} src=x><p>B two.</p>") == "A one.\nB two."
    closed = f"<div><p>A one.</p><{tag}>gone<b>gone</b></{tag}><p>B two.</p></div>"
    assert extraction.main_text(closed) == "A one.\nB two."
    # closed by the element around it, though another one is closed later
    around = f"<article><div><{tag}>gone</div><p>A one.</p><p>B two.</p><{tag}>gone</{tag}></article>"
    assert extraction.main_text(around) == "A one.\nB two."


@pytest.mark.parametrize("tag", sorted(extraction.RAW))
def test_a_slash_does_not_close_raw_elements(tag):
    page = f"<p>A one.</p><{tag} src='a.js'/>var x = '<p>no</p>';</{tag}><p>B two.</p>"
    assert extraction.main_text(page) == "A one.\nB two."


def test_foreign_elements_may_close_themselves():
    page = "<p>A one.</p><svg><path d='x'/><title>no</title><g/></svg><p>B two.</p><svg/><p>C.</p>"
    assert extraction.main_text(page) == "A one.\nB two.\nC."


def test_deep_pages_take_linear_time():
    started = time.perf_counter()
    shown = extraction.main_text("<div>word, " * 100_000)
    extraction.main_text("<b>word, " * 100_000)
    extraction.main_text("<div><li>word</li></i></span>" * 50_000)
    assert shown and time.perf_counter() - started < 10


def test_scores_equal_a_plain_recursion():
    rng = random.Random(6)
    tags = ["div", "p", "b", "a", "section", "ul", "li", "article", "span", "td", "h2"]
    for _ in range(200):
        page = "".join(
            rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "some words, here ", "x" * 150])
            for _ in range(rng.randrange(1, 60))
        )
        nodes = extraction.parse(page)
        extraction.score(nodes)
        chars, linked, points = {}, {}, {}

        def texts_in(node):
            return " ".join("".join(k for k in node.kids if isinstance(k, str)).split())

        def walk(node, link):
            link = link or node.tag == "a"
            own = len(texts_in(node))
            total, inside = own, own if link else 0
            for kid in node.kids:
                if not isinstance(kid, str):
                    t, i = walk(kid, link)
                    total, inside = total + t, inside + i
            chars[node.order], linked[node.order] = total, inside
            return total, inside

        def up(node):
            while node.tag not in extraction.BLOCKS and node.parent is not None:
                node = node.parent
            return node

        def own_of(block, node, link):
            """Text, commas and linked text that belong to a block itself."""
            link = link or node.tag == "a"
            text = texts_in(node)
            out = [len(text), text.count(","), len(text) if link else 0]
            for kid in node.kids:
                if not isinstance(kid, str) and kid.tag not in extraction.BLOCKS:
                    out = [a + b for a, b in zip(out, own_of(block, kid, link), strict=True)]
            return out

        def linked_above(node):
            return node is not None and (node.tag == "a" or linked_above(node.parent))

        walk(nodes[0], False)
        for block in nodes:
            if block.tag not in extraction.BLOCKS and block.parent is not None:
                continue
            n, commas, links = own_of(block, block, linked_above(block.parent))
            if not n:
                continue
            value = (1 + commas + min(n / 100, 3)) * (1 - links / n)
            at = up(block.parent) if block.leaf and block.parent is not None else block
            for share in (1, 2, 6, 9, 12):
                if at.tag in extraction.BLOCKS:
                    points[at.order] = points.get(at.order, extraction.BEGIN.get(at.tag, 0.0)) + value / share
                if at.parent is None:
                    break
                at = up(at.parent)
        for node in nodes:
            assert (node.chars, node.linked) == (chars[node.order], linked[node.order])
            assert node.score == pytest.approx(points.get(node.order))
