import html
import re

from fieldloom.llm import html_extract as he


def page(body, n=0):
    return f'<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style></head><body><nav><a href="/">Home</a></nav>{body}<footer>foot</footer>'


def test_extract():
    cases = {
        page("<article><h1>A &amp; B</h1><p>one\n two<b>three</b><p>four<br>five</article>"): "A & B one twothree four five",
        page('<header>h</header><div class="ad">x</div><main><p>m</p><form>f<input></form></main>'): "m",
        page('<div id="content"><p>body text</p></div><div class="cookie-notice">c</div><section class="comments"><p>hey</p></section>'): "body text",
        page('<article><p>x</p><script>var t="</p><p>no";</script><!-- <p>no</p> --><aside>s</aside><p>&lt;y&gt;&nbsp;z</p></article>'): "x <y> z",
        page('<article><ul><li>a<li>b</ul><div class="reader comments"><article>c</article></div></article>'): "a b",
        "": "",
        "plain": "plain",
        page("<article>" + "<p>w</p>" * 20_000 + "</article>"): " ".join(["w"] * 20_000),
        "<article><div>" * 3000 + "deep": "deep",
    }
    for p, want in cases.items():
        assert he.extract(p) == want
    assert he.extract(None) == ""


def test_template(spark):
    rows = [(i, f"http://Host.example/{i}", page(f"<article><div>Read this first</div><p>story {i}</p><p>Always here</p></article>", i), "x") for i in range(6)]
    rows += [(10, "http://other.example", page("<article><p>Always here</p></article>"), "x"), (11, None, None, "x"), (12, "http://host.example", "", "x"), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for most in (1 << 20, 0):
        got = sorted((r.page_id, r.text, r.n_chars) for r in he.main_text(df, most).collect())
        want = [(i, f"story {i}", 7) for i in (0, 1, 2, 3, 4, 5, 5)] + [(10, "Always here", 11), (11, "", 0), (12, "", 0)]
        assert got == sorted(want)
    assert he.main_text(df.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in he.main_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?b\b(?!r)", m[0]) else " ", inner)).split())
        assert got[r.page_id] == want


def texts(spark, bodies):
    rows = [(i, f"http://h.example/{i}", page(f"<article>{b}</article>")) for i, b in enumerate(bodies)]
    return [r.text for r in sorted(he.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_copies_are_one_page(spark):
    bodies = ["<p>same story</p>"] * 12 + ["<p>another</p>", "<p>third</p>"]
    assert texts(spark, bodies) == ["same story"] * 12 + ["another", "third"]


def test_a_page_counts_once(spark):
    bodies = ["<p>yes</p>" * 6 + "<p>a</p>", "<p>yes</p>" * 6 + "<p>b</p>", *(f"<p>story {i}</p>" for i in range(6))]
    assert texts(spark, bodies)[:2] == ["yes " * 6 + "a", "yes " * 6 + "b"]


def test_template_of_long_pages(spark):
    bodies = ["".join(f"<p>{i} {k}</p>" for k in range(80)) + "<p>Always here</p>" for i in range(3)]
    assert not any("Always" in t for t in texts(spark, bodies))


def test_wrappers_alone_and_names_alone(spark):
    """The tables' texts come out without any names, and the wrapper is what brings them out."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = {r.page_id: r.host for r in he.with_host(df).collect()}
    with_wrapper = {r.host for r in he.wrappers(df).collect()}
    full, alone, neither = ({r.page_id: r.text for r in x.collect()} for x in (he.main_text(df), he.main_text(df, names=False), he.main_text(df, names=False, wrapped=False)))
    ids = [i for i in full if host[i] in with_wrapper]
    assert len(ids) > 200
    assert sum(alone[i] == full[i] for i in ids) >= 0.97 * len(ids)
    assert not any(neither[i] == full[i] for i in ids)


def test_unnamed_parts(spark):
    """Generic elements only: what is constant goes, and what varies outside the region."""
    rnd = __import__("random").Random(2)
    w = lambda n: " ".join("w%03d" % rnd.randint(0, 999) for _ in range(n))
    rows, want = [], []
    for i in range(8):
        ps = [w(30) for _ in range(rnd.randint(3, 9))]
        extra = f"<div><p>{w(3)}</p></div>" if i % 4 == 0 else ""
        rows.append((i, f"http://g.example/{i}", f"<body><div><ul><li><a href=x>{w(2)}</a><li><a href=y>{w(1)}</a></ul></div>{extra}<div><h1>T {i}</h1><p>By the staff</p>{''.join(f'<p>{p}</p>' for p in ps)}</div><div><p>{w(4)}</p></div></body>"))
        want.append(" ".join([f"T {i}", *ps]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for names in (True, False):
        assert [r.text for r in sorted(he.main_text(df, names=names).collect())] == want


def test_a_name_does_not_outweigh_the_text():
    assert he.extract('<div class="search">' + "<p>word word word</p>" * 20 + '</div><div class="related">other</div>') == " ".join(["word word word"] * 20)


def test_simple_tree_matching():
    a, b = (he.fold(he.parse(x)) for x in ("<div><ul><li>1</ul></div><p>t</p><div><p>x<h2>y</h2></div>", "<p>t</p><div><h2>k</h2><p>x<h2>y</h2></div>"))
    he.align(b, he.read(he.written(a)))
    shape = he.json.loads(he.written(a))
    p, div = b.children
    assert shape[p.number][1] == "p" and shape[div.number][1] == "div" and div.number > p.number
    assert [c.number >= 0 for c in div.children] == [False, True, True]


def test_markup_of_any_length_is_read_in_time():
    import time

    start = time.time()
    for x in ("<a b ", "<", "<!", "<a x='", '<a x=">', "</x>", "<div>", "<b><p>", "<!-- ", "<script>", "&", "<p><b>", '<a "'):
        he.extract(x * (400_000 // len(x)))
    he.extract("<div>" * 100_000 + "</b>" * 100_000)
    assert time.time() - start < 60
    assert he.extract("one <a b " * 3) == "one <a b one <a b one <a b"
    assert he.extract('x <a t="1>2" q>y</a> 3 < 4 <b>z') == "x y 3 < 4 z"
    assert he.extract("<b>" * 2000 + "deep" + "</b>" * 2000 + " end") == "deep end"
