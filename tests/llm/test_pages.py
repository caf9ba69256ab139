"""Operators on pages."""

from __future__ import annotations

import time

import brute
import duckdb
import numpy as np
import pytest
from brute import rows_of

from rinse.llm import html_text, url_filter, warc
from rinse.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TREE = html_text.train(*html_text.labelled_table())


def text(page):
    return html_text.main_text(page, TREE)[0]


def test_tree_fits_its_table():
    x, y = html_text.labelled_table()
    assert np.mean([html_text.classify(TREE, r) == v for r, v in zip(x, y)]) > 0.95


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("<script>var t = '</p>'", ""), ("<!-- a <p>b</p>", ""),
    ("<article><h1>A &amp; B</h1><p>one\n  <b>two</b>three<br>four</p></article>", "A & B one twothree four"),
    ("<nav><a href=/>Home</a></nav><article><p>Text &lt;i&gt; &#233; x.</article><footer>&copy; me</footer>", "Text <i> é x."),
    ("<article><p>Body.</p><section class='comments'><p>First comment, and a rather long one, too, as comments go.</p></section></article>", "Body."),
    ("<main><p>Body.</p><form><label>Name</label><button>Send</button></form><style>p{}</style></main>", "Body."),
    ("<div class='notice'>We use cookies.</div><article><p>Body.</p><div class=\"ad\">Buy <b>now</b></div></article><aside>Links</aside>", "Body."),
    ("<article><p title='a > b'>Body</p></article>", "Body"),
])
def test_main_text(page, want):
    assert text(page) == want


_LONG = " ".join(x.removeprefix("<p>") for x in [html_text._S, html_text._M])


@pytest.mark.parametrize("before, after", [
    ("<body class='has-sidebar'><article>", "</article></body>"), ("<div id='page' class='no-sidebar'><article>", "</article></div>"),
    ("<div id='page' class='no-sidebar'><div class=content>", "</div></div>"), ("<div class='container with-comments'><div class=content>", "</div></div>"),
    ("<article class='post comments-open'>", "</article>"), ("<body class='comments sidebar'><main id=menu>", "</main></body>"),
    ("<div class='layout sidebar-left'><div class=content>", "</div></div>"), ("<div class='post comment-count'>", "</div>")])
def test_wrapper_names_do_not_hide_the_page(before, after):
    assert text(f"{before}<h1>Title</h1><p>{_LONG}</p><p>Yes.</p>{after}") == f"Title {_LONG} Yes."


@pytest.mark.parametrize("markup", ["<div class=sidebar>", "<div class='comments-list'>", "<nav><div class=content>", "<div class=cookie-notice><div class=content>",
                                    "<div class=comments><div class=content>"])
def test_asides_and_comments_stay_out(markup):
    assert text(f"<article><p>Body.</p></article>{markup}<p>{_LONG}</p>") == "Body."


@pytest.mark.parametrize("inside, want", [
    ("<p>One <svg viewBox='0 0 1 1'/> two</p><p>Three</p>", "One two Three"), ("<p>One <math/> two</p><p>Three</p>", "One two Three"),
    ("<p>One <svg><title>t</title><g><text>x</text></g></svg>two</p>", "One two"),
    ("<p>With <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> it holds.</p>", "With x=2 it holds."),
    ("<p>With <math><semantics><mi>x</mi><annotation encoding='application/x-tex'>x</annotation></semantics></math>.</p>", "With x."),
    ("<div><button>Share</div><p>Body.</p>", "Body."), ("<button>Share<p>Body.</p><p>More.</p>", "Body. More."),
    ("<object data=a><p>One.</p></article><article><p>Two.</p>", "One. Two."),
    ("<object>a<object>b</object>c</object><p>Body.</p>", "Body."), ("<button><div>Send</div> it</button><p>Body.</p>", "Body."),
    ("<select><option>a<option>b</select><p>Body.</p>", "Body."), ("<p>A<video><p>No video.</p></video>B</p>", "AB"),
    ("<p>One</p><svg><g></article><article><p>Two</p>", "One Two"), ("<p>One</p><textarea><p>x</p></textarea><p>Two</p>", "One Two")])
def test_dropped_elements_end_like_others(inside, want):
    assert text(f"<article>{inside}</article>") == want


def asked(tree):
    return {html_text.FEATURES[tree[0]]} | asked(tree[2]) | asked(tree[3]) if isinstance(tree, tuple) else set()


def test_tree_asks_words_and_links_of_block_and_neighbours():
    assert {"words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "name", "section"} <= asked(TREE)


@pytest.mark.parametrize("style", ["tags", "names", "mixed", "bare"])
def test_held_out_pages(style):
    x, y = html_text.labelled_table([html_text.labelled_page(10_000 + i, style) for i in range(150)])
    assert np.mean([html_text.classify(TREE, r) == v for r, v in zip(x, y)]) > 0.97


def test_held_out_bare_pages_have_no_marks():
    pages = ["".join(m for m, _ in html_text.labelled_page(10_000 + i, "bare")) for i in range(150)]
    assert not any(w in p for p in pages for w in ("class", "id=", "<article", "<main", "<nav", "<header", "<footer", "<aside", "<section"))


@pytest.mark.parametrize("page", [
    "<div class=content><div class='share-post'><p>X</p></div></div>", "<div class=content><section id='social-history'><p>X</p></section></div>",
    "<div class=content><section class='legal-history'><p>X</p></section></div>", "<article><div class='entry-header'><h1>X</h1></div></article>",
    "<article><p class=alert>X</p></article>", "<article><p class='search-results'>X</p></article>", "<main><div class=alert><p>X</p></div></main>",
    "<nav><a href=#>One</a><p><a href=#>Two</a></nav><article><p>X</p></article>"])
def test_listed_words_do_not_drop_article_text(page):
    assert text(page.replace("X", _LONG)) == _LONG


def test_every_plain_block_of_an_article_stays():
    rng = np.random.default_rng(5)
    at = {f: i for i, f in enumerate(html_text.FEATURES)}
    for _ in range(5000):
        row = np.zeros(len(at))
        row[at["words"]], row[at["section"]], row[at["heading"]] = rng.choice([1, 3, 9, 40]), html_text.MAIN, rng.integers(2)
        for side in ("before", "after"):
            for k in ("", "_2"):
                row[at[f"words_{side}{k}"]] = n = rng.choice([0, 1, 3, 9, 40])
                row[at[f"links_{side}{k}"]] = rng.integers(2) if n else 0
        assert html_text.classify(TREE, row) == 1


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</b>" * 100_000, "<b></i>" * 100_000, "<svg>" * 1000 + "<g></p>" * 100_000,
                                  "<object>" * 100_000 + "<p>x" * 100_000, "<svg><div>" * 100_000])
def test_long_pages_take_linear_time(page):
    start = time.process_time()
    text(page)
    assert time.process_time() - start < 10  # about a second; minutes if each tag walked the open elements


def test_very_long_page():
    assert text(f"<article>{'<p>one two</p>' * 200_000}</article>") == " ".join(["one two"] * 200_000)


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<article>é</article>", 0), (None, None, None, 1), (1, "u", "", 2)]
    got = rows_of(html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string, n_chars int")), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, "u", "é", 1), (None, None, "", 0), (1, "u", "", 0)], key=repr)
    assert html_text.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


def test_extract_on_the_table(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in QUERIES["op1_html_text"](spark, SMALL).collect()}
    assert len(got) == len(pages) and all(got[i]["n_chars"] == len(got[i]["text"]) for i, _ in pages)
    assert not any("All rights reserved" in got[i]["text"] and "All rights" not in p.split("<article>")[1].split("</article>")[0] for i, p in pages)


def test_warc_round_trip_with_magic_in_payloads(spark):
    evil = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "x"), (2, None), (3, ""), (4, evil), (5, evil * 3 + "WARC/1.1\r\n"), (6, "\r\n\r\n"), (7, "x"), (8, evil),
            (9, "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (10, "é漢" * 2000)]
    rows += [(100 + i, f"p{i % 17} " * i + (evil if i % 5 == 0 else "")) for i in range(80)]
    df = spark.createDataFrame([(i, f"u\r\n{i}", t, "x") for i, t in rows], "page_id bigint, url string, html string, file string").coalesce(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = rows_of(warc.warc_round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == brute.warc(rows)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x"), (3, "x"), (3, "x"), (4, "y")], "page_id bigint, html string").selectExpr("*", "NULL AS url")
    got = rows_of(warc.warc_round_trip(df), "page_id", "record_type", "refers_to")
    assert got == sorted([(None, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None)], key=repr)


@pytest.mark.parametrize("key, value", [("spark.sql.files.maxPartitionBytes", "900"), ("spark.sql.files.minPartitionNum", "64")])
def test_warc_splits_stay_when_settings_change_between_the_scans(spark, key, value):
    rows = [(i, f"p{i} " * 60 + ("WARC/1.1\r\n" if i % 7 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id bigint, url string, html string").coalesce(1)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "3")  # as if three cores were registered
    try:
        read = warc.warc_round_trip(df)
        spark.conf.set(key, value)
        got = rows_of(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(got) == brute.warc(rows)


def test_warc_piece_of_an_unknown_split_is_an_error(spark):
    pieces = spark.createDataFrame([(1, 0, 10, 5), (1, 64, 10, 5)], "file bigint, block bigint, at bigint, size bigint")
    bases = spark.createDataFrame([(1, 0, 0)], "file bigint, block bigint, base bigint")
    assert rows_of(warc.placed(pieces.limit(1), bases), "off") == [(0,)]
    with pytest.raises(Exception, match="was not there"):
        warc.placed(pieces, bases).join(pieces.selectExpr("file", "at AS off"), ["file", "off"], "left_anti").collect()


def test_pointer_jumping_stops_at_a_broken_chain(spark):
    chain = spark.createDataFrame([("f", 0, 10), ("f", 10, 25), ("f", 12, 25), ("f", 25, 99), ("g", 3, 9), ("f", 50, 60)], "file string, off bigint, nxt bigint")
    assert rows_of(warc.reachable(chain), "file", "off") == [("f", 0), ("f", 10), ("f", 25)]


def test_url_filter_intervals(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame(
        [("domain:a.org", "block", "add", day(5), 1), ("domain:a.org", "block", "remove", day(9), 2), ("prefix:x.a.org/ok/", "allow", "add", day(6), 3),
         ("host:b.org", "block", "add", day(1), 4), ("host:b.org", "block", "remove", day(1), 5), (None, "block", "add", day(1), 6),
         ("domain:a.org", "block", "add", day(5), 1)], "key string, list string, action string, day date, seq bigint")
    caps = [(1, "http://x.A.org:80/p", day(4)), (2, "http://x.a.org/p", day(5)), (3, "https://u@x.a.org/ok/z?q", day(8)), (4, "http://a.org/ok/", day(8)),
            (5, "http://a.org", day(9)), (6, "http://b.org/", day(3)), (7, None, day(8)), (8, "http://a.org", None), (8, "http://nota.org/", day(8))]
    got = rows_of(url_filter.url_filter(spark.createDataFrame(caps, "page_id bigint, url string, fetch_day date"), entries), "page_id", "n_active", "matched", "blocked")
    assert got == sorted([(1, 0, None, False), (2, 1, "domain:a.org", True), (3, 2, "prefix:x.a.org/ok/", False), (4, 1, "domain:a.org", True),
                          (5, 0, None, False), (6, 0, None, False), (7, 0, None, False), (8, 0, None, False), (8, 0, None, False)], key=repr)


def test_url_filter_every_page_names_an_entry(spark):
    pages = spark.createDataFrame([(i, f"http://a{i}.b.org/x/y/z/w?q") for i in range(28)] + [(None, "http://c.org/"), (28, None), (32, "http://d.org")],
                                  "page_id bigint, url string")
    keys = {r["seq"]: r["key"] for r in url_filter.entries_of(pages).collect()}
    assert sorted(keys) == [*range(28), 32]
    assert keys[0] == "host:a0.b.org" and keys[2] == "domain:b.org" and keys[32] == "prefix:d.org/"
    assert [keys[i] for i in (4, 5, 6, 11)] == ["prefix:a4.b.org/", "prefix:a5.b.org/x/", "prefix:a6.b.org/x/y/", "prefix:a11.b.org/x/y/z/"]


def test_url_filter_empty_tables(spark):
    caps = url_filter.captures_of(spark.createDataFrame([(1, "http://a.org/" + "x/" * 2000)], "page_id bigint, url string"))
    entries = url_filter.entries_of(caps.limit(0))
    assert url_filter.url_filter(caps.limit(0), entries).collect() == []
    assert rows_of(url_filter.url_filter(caps, entries), "page_id", "n_active", "blocked") == [(1, 0, False)]


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle(spark, key):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = con.execute(ORACLE[key])
    cols = [c[0] for c in want.description]
    df = QUERIES[key](spark, SMALL)
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df, *cols) == sorted(want.fetchall(), key=repr)
