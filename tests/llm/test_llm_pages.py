"""Main text of pages, URL verdicts and shards."""

from __future__ import annotations

import re
import time
from html import unescape

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cantiga.llm import html_text, sharding, url_templates
from cantiga.llm.queries import ORACLE, QUERIES, URL_RULES
from checks.compare import compare, database

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_against_sql(spark, name, folder):
    good, text = compare(spark, database(folder), folder, name, QUERIES[name], ORACLE[name])
    assert good, text


def test_main_text_is_the_article_of_every_page(spark):
    """Against a plain cut of the markup these pages use."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r for r in QUERIES["op5_main_text"](spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == len(pages)
    for page in pages:
        inside = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
        assert (found[page.page_id].text, found[page.page_id].n_chars) == (want, len(want))


PAGES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("<p></p><script>x</script>", ""),
    ("plain words only", "plain words only"),
    ("<p>a &amp; b&nbsp;&#99;  d<p>next<br>line", "a & b c d\nnext line"),
    ("<nav>Menu</nav><main><p>Long text of the page, and more of it.</p></main><footer>Foot</footer>", "Long text of the page, and more of it."),
    ("<article><header><h1>Title</h1></header><p>Body</p><div class='comments'><p>Reader</p></div><form>Name</form></article>", "Title\nBody"),
    ("<body><div class=cookie-notice>We use cookies</div><div id=sidebar>Links</div><div><p>The story is told here at length.</p></div></body>", "The story is told here at length."),
    ("<style>p{}</style><p>A <b>bold <i>word</b> left</p><!-- note --><aside>Side</aside>", "A bold word left"),
    ("<article><p>unclosed <b>tags <p>go on", "unclosed tags\ngo on"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


BODY = "<h1>Title</h1><p>The story is told here at length, and goes on.</p>"
STORY = "Title\nThe story is told here at length, and goes on."
WRAPPED = [
    *[f"<body><div {mark}>{BODY}</div></body>" for mark in ("class='content has-sidebar'", "class=no-sidebar", "class=with-nav", "class='post comments-open'", "id=page-header-layout")],
    *[f"<article {mark}>{BODY}</article>" for mark in ("class='content has-sidebar'", "class='post comments-open'", "class='widget'", "id=page-header-layout")],
    "<article><header class='entry-header'><h1>Title</h1></header><p>The story is told here at length, and goes on.</p></article>",
    "<article><div class='entry-header'><h1>Title</h1></div><p>The story is told here at length, and goes on.</p></article>",
    f"<div class=sidebar><article>{BODY}</article></div><div class=comments><p>{'A reader says much more than that. ' * 9}</p></div>",
    f"<div id=search><div>{BODY}</div></div><div class=related-posts><p>More</p></div>",
    # What a token names is still left out.
    f"<div class='share-buttons'>Share</div><div class='col site-nav'>Links</div><div id=sidebar2>Side</div><div>{BODY}</div><ol class=comment-list><li><article>{'Reader ' * 30}</article></ol>",
]


@pytest.mark.parametrize("html", WRAPPED)
def test_a_word_of_a_class_does_not_take_the_article(html):
    assert html_text.main_text(html) == STORY


LONG = "The story is told here at length, and goes on for a while longer than that. " * 3
PARTS = "".join(f"<div><p>{LONG}</p></div>" for _ in range(3))
LINKS = "".join(f"<li><a href=x>See also this page {i}</a>" for i in range(6))
TOLD = "\n".join([LONG.strip()] * 3)
LOST = [
    # Teasers in <article> below a story that is in none.
    (f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><article><a href=x>More of this</a></article><article><a href=y>And of that</a></article></body>", TOLD),
    # The same, in the article of the page.
    (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><a href=x>More of this</a></article><div>Outside</div>", TOLD),
    # Two articles of one kind.
    (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article><article><p>{LONG}</p></article>", TOLD),
    # A form around the page, and one to fill in.
    (f"<body><form action=x><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></form></body>", TOLD),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><form>Your name <input><button>Send</button></form></div></body>", TOLD),
    ("<body><form>Your name <input>Your word <input></form></body>", ""),
    # A short last paragraph in an element of its own, after a list of links.
    (f"<body><div id=story>{PARTS}<div><ul>{LINKS}</ul></div><div>The end.</div></div><div>Imprint</div></body>", f"{TOLD}\nThe end."),
]


@pytest.mark.parametrize("html, text", LOST)
def test_articles_that_tags_do_not_give_away(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    "piece", ["<b>x</i>", "<p><div><b></p><p>", "<div class=ad>x", "<li><b>x", "</p><p>", "<article><h1>x", "<form><td>x<td>", "<a href='x'>y</b>", "<", "&#", "<!--", "<!--x>", "<![CDATA[x>", "<![x>", "<!x", "<?x", "<a ", "<a b='", "</b ", "<script>", "<script><", "&amp", "<div><b>"]
)
def test_broken_markup_takes_time_that_grows_with_the_page(piece):
    def seconds(n):
        began = time.process_time()
        html_text.main_text(piece * n)
        return time.process_time() - began

    n = 20_000 // len(piece)
    few, many = min(seconds(n) for _ in range(2)), seconds(8 * n)
    assert many < 3 or many < 24 * few, (few, many)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<![", "<!--", "-->", "]]>", "<", ">", "</", "<p>", "</p>", "<b>", "<form>", "</form>", "<article>", "<div class=ad>", "</div>", "<td>", "<script>", "</script>", "x y", "&#", "&amp;", "<?", "<!x", "'", '"', "=", "<a href='", "\0", "\ud800"]), max_size=30))
def test_broken_markup_is_read(pieces):
    assert isinstance(html_text.main_text("".join(pieces)), str)


def test_main_text_of_a_very_long_page_and_odd_rows(spark):
    long = "<article>" + "<p>Some words of a paragraph.</p>" * 30_000 + "</article>"
    pages = spark.createDataFrame([(1, None, None, "c"), (None, "u", long, None), (2, "u", "<p>a", "c"), (2, "u", "<p>a", "c")], "page_id long, url string, html string, text string")
    rows = html_text.extract_main_text(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, 1, 1, 30_000 * 27 - 1]
    assert set(rows[0].asDict()) == {"page_id", "url", "text", "n_chars"}
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


URLS = [
    (None, "", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    ("http://WWW.Example.COM/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=/en/", "example.com", "", None, "allow"),
    ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net/es", "a.net", "/es", None, "allow"),
    ("http://\u00c4.net/fr/", "\u00c4.net", "/fr/", "net/fr/", "block"),
    ("http://a://b/c", "a:", "//b/c", None, "allow"),
    ("://", "", "", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    urls = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "id long, url string")
    labels = spark.createDataFrame([], "id long, good int")
    rows = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge_urls(urls, labels, URL_RULES).collect()}
    assert rows == {i: u[1:] for i, u in enumerate(URLS)}


def test_a_template_of_bad_labels_is_rejected(spark):
    rows = [(i, f"http://h.org/{'bad' if i % 2 else 'good'}/{i}/x", 1 - i % 2) for i in range(80)] + [(None, None, None), (900, "http://h.org/bad/900/x", None), (900, "http://h.org/bad/900/x", None)]
    urls = spark.createDataFrame([r[:2] for r in rows], "id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, good int")
    judged = url_templates.judge_urls(urls, labels, []).collect()
    assert len(judged) == len(rows)
    assert {(r.template, r.verdict) for r in judged if r.host} == {("/bad/*/x", "block"), ("/good/*/x", "allow")} or {(r.template, r.verdict) for r in judged if r.host} == {("/bad/*/*", "block"), ("/good/*/*", "allow")}
    assert url_templates.judge_urls(urls.limit(0), labels, []).count() == 0


def test_branches_of_any_share_and_depth_are_kept_apart(spark):
    """A branch of 1 % of its node, 1 of 60 equal sections, and branches that differ in the fourth and sixth segment only."""
    paths = [("a.org", f"/small/{i}", 0) for i in range(20)] + [("a.org", f"/large/{i}", 1) for i in range(1980)]
    paths += [("b.org", f"/s{i % 60}/{i}", int(i % 60 != 7)) for i in range(1800)]
    paths += [("c.org", f"/x/y/z/{'bad' if i % 2 else 'fine'}/{i}", 1 - i % 2) for i in range(200)]
    # Users with too few pages of either kind each.
    paths += [("d.org", f"/x/y/u/{i // 4}/k/{'bad' if i % 2 else 'fine'}/{i}", 1 - i % 2) for i in range(200)]
    urls = spark.createDataFrame([(i, f"http://{host}{path}") for i, (host, path, _) in enumerate(paths)], "id long, url string")
    labels = spark.createDataFrame([(i, good) for i, (_, _, good) in enumerate(paths)], "id long, good int")
    judged = {r.id: r for r in url_templates.judge_urls(urls, labels, []).collect()}
    assert len(judged) == len(paths)
    assert [i for i, r in judged.items() if (r.verdict == "allow") != bool(paths[i][2])] == []
    templates = {r.template for r in judged.values()}
    assert {"/small/*", "/s7/*", "/*/*/*/bad/**", "/*/*/*/fine/**", "/*/*/*/*/*/bad/**", "/*/*/*/*/*/fine/**"} <= templates


def test_sql_of_the_urls_far_down_and_among_small_shares(spark, tmp_path):
    """The SQL follows the query beyond three segments and below 2 % of a node."""
    paths = [("a.org", f"/small/{i}", 0) for i in range(20)] + [("a.org", f"/large/{i}", 1) for i in range(1980)]
    paths += [("b.org", f"/s{i % 60}/{i}", int(i % 60 != 7)) for i in range(1800)]
    paths += [("c.org", f"/x/y/z/{'bad' if i % 2 else 'fine'}/{i}", 1 - i % 2) for i in range(200)]
    paths += [("d.org", f"/x/y/u/{i // 4}/k/{'bad' if i % 2 else 'fine'}/{i}", 1 - i % 2) for i in range(200)]
    paths += [("d.org", f"//*/{i % 3}//", i % 2) for i in range(60)] + [("e.org", "", None), ("e.org", "/", 1), ("www.example.com", "/en/1", 0)]
    rows = [(i, f"http://{host}{path}?q", good) for i, (host, path, good) in enumerate(paths)] + [(5, None, 1), (None, "http://a.org/small/1", None)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    connection = duckdb.connect()
    for name in ("pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    good, text = compare(spark, connection, str(tmp_path), "op9_url_verdicts", QUERIES["op9_url_verdicts"], ORACLE["op9_url_verdicts"])
    assert good, text
    assert QUERIES["op9_url_verdicts"](spark, str(tmp_path)).where("template LIKE '/*/*/*/bad%' OR template LIKE '/small%'").count() == 121


def test_urls_are_judged_without_python(spark):
    plan = QUERIES["op9_url_verdicts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shards_fit_and_hold_every_row_once(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for key in ("doc_id", "lang", "source"):
        shards = sharding.extendible_shards(documents, F.col(key), F.octet_length("text"), 50_000, ["doc_id"])
        rows = shards.rows.toPandas()
        assert sorted(rows["doc_id"]) == list(range(1000))
        per_shard = rows.groupby("shard")["bytes"].agg(["sum", "size"])
        assert ((per_shard["sum"] <= 50_000) | (per_shard["size"] == 1)).all()
        assert (rows["shard"].str.len() == rows["depth"]).all()
        # A prefix code: no bucket lies within another.
        names = sorted(per_shard.index)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
        directory = {r.shard: (r.bytes, r.rows) for r in shards.directory.collect()}
        assert directory == {k: tuple(v) for k, v in per_shard.iterrows()}


def test_shards_of_odd_rows(spark):
    rows = [(None, None, 1)] * 3 + [(1, "x" * 500, 2)] + [(2, "y" * 40, 3)] * 50
    frame = spark.createDataFrame(rows, "k long, text string, depth int")
    shards = sharding.extendible_shards(frame, F.col("k"), F.octet_length("text"), 100)
    got = shards.rows.toPandas()
    assert len(got) == len(rows) and set(got.columns) == {"k", "text", "shard", "depth", "bytes"}
    sums = got.groupby("shard")["bytes"].agg(["sum", "size"])
    assert ((sums["sum"] <= 100) | (sums["size"] == 1) | (got[got["bytes"] > 0].groupby("shard").size().reindex(sums.index).fillna(0) <= 1)).all()
    empty = sharding.extendible_shards(frame.limit(0), F.col("k"), F.octet_length("text"), 100)
    assert empty.rows.count() == 0 and empty.directory.count() == 0
