from pyspark.sql import functions as F

from panelweave.llm import html_text as ht


def text(page):
    return "\n\n".join(ht.blocks(ht.main_parts(ht.parse(page))))


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Top</header><nav><ul><li>Menu</ul></nav><!-- note --><div class="cookie-notice">Accept</div><aside>Side</aside>
    <article><header><h1>Head &amp; more</h1></header><p>One <b>two<br>three<p>Four&nbsp;five &lt;x&gt; &#233;</p><form>Sign up <input></form>
    <div class="ad">Buy</div><ul><li>first<li>second</ul><table><tr><td>a<td>b</table><pre>c
    d</pre><section id="comments"><p>Nice!</p></section></article><footer>&copy; x</footer></body></html>"""
    assert text(page) == "Head & more\n\nOne two three\n\nFour five <x> é\n\nfirst\n\nsecond\n\na\n\nb\n\nc d"


def test_marks_that_are_about_the_text_drop_nothing():
    page = """<article><h2 id="social-impact">Impact</h2><section id="related-work"><p class="share price">A share costs <math><mi>x</mi>
    <mo>+</mo><mn>1</mn></math> now</p></section><h3 id="comments">Comments</h3><p id="ad">First</p><div class="share sidebar">Tell all</div>
    <section class="comments">Nice</section><p class="ad">Buy</p><div id="newsletter">Sign up</div></article>"""
    assert text(page) == "Impact\n\nA share costs x +1 now\n\nComments\n\nFirst"


def test_counts_find_menus_that_bear_no_mark(spark):
    menu = "<div><ul><li><a href='/a'>Start</a><li><a href='/b'>All texts</a></ul></div>"
    foot = "<div><span>Made by us</span><div>Write to us</div></div>"
    pages = [(i, f"http://plain.example/{i}", f"<html><body>{menu}<div><h1>Title {i}</h1><p>Text {i}.</p></div>{foot}</body></html>") for i in range(25)]
    table = rows(spark, pages)
    assert {r["text"] for r in ht.extract(table).collect()} == {f"Title {i}\n\nText {i}." for i in range(25)}
    untouched = {r["text"] for r in ht.extract(table, min_pages=10**9).collect()}
    assert all("All texts" in t and "Write to us" in t for t in untouched)


def test_broken_pages():
    assert text("") == ""
    assert text("plain") == "plain"
    assert text("<article><p>a</div></p>b</article>c") == "a\n\nb"
    assert text("<article><p>open <b>end") == "open end"
    assert text("<article><p>x &am") == "x &am"
    assert text("<article>a<p") == "a"
    assert text("a < b <3 > c") == "a < b <3 > c"
    assert text("<script>never closed <p>x") == ""
    assert text("<main><p>a</p></main><p>b</p>") == "a"
    assert text("<article><p>1</p></article><p>x</p><article><p>2</p></article>") == "1\n\n2"
    assert text('<article><p title="a>b">q</p></article>') == "q"
    assert text("<p>a</p><p hidden>b</p><div style='display: none'>c</div><div role=navigation>d</div>") == "a"
    assert text("<article>" + "<div>" * 5000 + "deep") == "deep"


def rows(spark, pages):
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for name in ("host", "key", "templates", "text"):
        table = table.withColumn(name, F.lit("own"))
    return table


def test_templates_of_a_site_go_and_articles_stay(spark):
    box = "<div><div>Get our daily letter</div><div>Now</div></div>"
    pages = [(i, f"https://user@Site.example:80/{i}", f"<html><body><p>Same sentence everywhere.</p><p>Body {i} text.</p>{box}</body></html>") for i in range(30)]
    pages += [(100 + i, "http://other.example/x", f"<article><p>Shared quote.</p><p>Own {i}</p>{box}</article>") for i in range(4)]
    pages += [(200 + i, "http://third.example/x", f"<article><p>Shared quote.</p><p>Own {i}</p>{box}</article>") for i in range(30)]
    pages += [(300 + i, "http://copies.example/x", f"<article><p>Whole page.</p>{box}</article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in ht.extract(rows(spark, pages)).collect()}
    letter = "Get our daily letter\n\nNow"
    # Without an article the recurring paragraph is furniture too.
    assert got[3] == "Body 3 text."
    assert got[101] == f"Shared quote.\n\nOwn 1\n\n{letter}"  # too few pages to tell
    assert got[207] == "Shared quote.\n\nOwn 7"
    assert got[300] == f"Whole page.\n\n{letter}"  # copies of one page are one page


def test_odd_rows(spark):
    pages = [(1, None, None), (1, None, None), (None, "x", "<p>a"), (2, "not a url", ""), (3, "http://a.example/", "<p>b</p>")]
    table = ht.extract(rows(spark, pages))
    assert table.columns == ["page_id", "url", "text"]
    assert sorted(((r["page_id"], r["text"]) for r in table.collect()), key=str) == sorted([(1, ""), (1, ""), (None, "a"), (2, ""), (3, "b")], key=str)
    assert ht.extract(rows(spark, []).limit(0)).collect() == []


def test_the_box_of_one_section_goes_on_hosts_of_any_size(spark):
    box = "<div><div>News of the section</div></div>"
    for n in (40, 600):
        pages = [(i, f"https://big.example/{i}", f"<article><div>Own {i}</div>{box if i < 12 else ''}</article>") for i in range(n)]
        got = {r["page_id"]: r["text"] for r in ht.extract(rows(spark, pages)).collect()}
        assert got == {i: f"Own {i}" for i in range(n)}


def test_pages_move_only_if_a_template_lies_in_their_text(spark, monkeypatch):
    written = {}
    write = ht.Stages.write

    def noted(self, df, name, options=None):
        written[name] = write(self, df, name, options)
        return written[name]

    monkeypatch.setattr(ht.Stages, "write", noted)
    menu, box = "<nav><ul><li>Start</ul></nav>", "<div><div>Write to us</div></div>"
    pages = [(i, f"http://a.example/{i}", f"<body>{menu}<article><p>Own {i}</p>{box if i % 4 == 0 else ''}</article>{box}</body>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in ht.extract(rows(spark, pages)).collect()}
    assert got == {i: f"Own {i}" for i in range(60)}
    assert written["found"].count() == 15


def test_shuffled_pages_travel_packed(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        box = "<div><div>Write to us \u20ac\U0001f600</div></div>"
        pages = [(i, f"http://a.example/{i}", f"<article><p>Own {i} \u00e9\U0001f600 {'word ' * 2000}</p>{box}</article>") for i in range(40)]
        texts = ht.extract(rows(spark, pages + [(None, None, None)] * 2))
        got = sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in texts.collect())
        assert got == [(-1, ""), (-1, "")] + [(i, f"Own {i} \u00e9\U0001f600 {'word ' * 2000}".strip()) for i in range(40)]
        joined = next(line for line in texts._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInPandas _packed" in line)
        assert "packed" in joined
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
