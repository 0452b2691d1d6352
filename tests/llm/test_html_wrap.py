import random
import time

import pytest

from tessera.llm import dom, html_wrap
from tessera.llm.dom import Page, Shapes, read_page
from tessera.llm.html_wrap import Wrapper, extract_pages, induce, induce_wrappers, main_text, plain_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title>{t}</title><style>p{{}}</style><script>var t="</p><article>no";</script></head><body><nav><ul><li><a href="/">home {t}</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy {t}</div>
<div class="wrap"><h1>{t} &amp; co</h1><p><b>First {t}.<br><p>Second&nbsp;line\n of {t}, longer than any advert on the page<ul><li>one {t}<li>two {t}</ul><div id="comments"><p>reader</p></div><form><p>mail</p></form></div><footer>&copy; {t}</footer>"""
WANT = "{t} & co\nFirst {t}.\nSecond line of {t}, longer than any advert on the page\none {t}\ntwo {t}"


def random_page(rng, depth):
    page = Page()

    def grow(parent, depth):
        for _ in range(rng.randint(0, 3) if depth else 0):
            page.name.append(rng.choice("ab"))
            page.parent.append(parent)
            grow(len(page.name) - 1, depth - 1)

    grow(0, depth)
    return page.finish()


def brute(a, i, b, j):
    """Size of the largest match by trying every order-keeping choice of children."""
    if a.name[i] != b.name[j]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute(a, x[0], b, y[0]))

    return 1 + best(a.kids[i], b.kids[j])


def test_tree_matching():
    rng = random.Random(8)
    for _ in range(150):
        a, b, shapes = random_page(rng, 3), random_page(rng, 3), Shapes()
        of_a, of_b = shapes.of(a), shapes.of(b)
        n, pairs = shapes.weight(of_a[0], of_b[0]), shapes.pairs(a, b, of_a, of_b)
        assert n == brute(a, 0, b, 0) == len(pairs)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == n
        assert all(a.name[x] == b.name[y] and (x == 0 or (a.parent[x], b.parent[y]) in pairs) for x, y in pairs)


@pytest.mark.parametrize("n", [20, 300, 520, 900])
def test_long_lists_of_siblings_match_whole(n):
    pages = [read_page("".join(f"<div><p>{'<ul>' * (i % 7)}x</div>" for i in range(k, n + k))) for k in (0, 1)]
    shapes = Shapes()
    of = [shapes.of(p) for p in pages]
    # all but the first of one and the last of the other are equal subtrees
    same = sum(pages[0].size[k] for k in pages[0].kids[0][1:])
    assert shapes.weight(of[0][0], of[1][0]) > same


def test_alignment_decides(spark):
    """Pages without any name to go by: only the alignment tells the article from the rest."""
    page = lambda t, n: f"<body><div><p>Welcome to the house of pages</div><div><p>pick of the day: {t}</div><div><p>All we know of {t} is written here at length</p><p>This line is on each page</p>" + "".join(f"<p>part {k} of {t}" for k in range(n)) + "</div><div><p>write us</div>"
    pages = [page(f"thing{i}", 2 + i % 4) for i in range(8)]
    said = induce(pages)
    wanted = lambda t, n: "\n".join([f"All we know of {t} is written here at length", *(f"part {k} of {t}" for k in range(n))])
    for t, n in (("thing3", 5), ("other", 9)):
        got, wrapped = main_text(read_page(page(t, n)), Wrapper(said))
        assert wrapped and got == wanted(t, n)
        assert plain_text(read_page(page(t, n))) != got
    # the same text elsewhere than the template has it is kept
    moved = page("new", 3).replace("part 1 of new", "Welcome to the house of pages")
    assert main_text(read_page(moved), Wrapper(said))[0].split("\n")[2] == "Welcome to the house of pages"
    # two layouts of one host have a wrapper each
    other = lambda t: f"<body><table><tr><td><div>{t} menu</div><td><h2>About {t}</h2><div>{t} is a long story with many words</div></table>"
    rows = [(i, f"http://h.example.com/{i}", pages[i]) for i in range(8)] + [(10 + i, f"http://h.example.com/t{i}", other(f"item{i}")) for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    wrappers = induce_wrappers(frame)
    assert [len(r.wrappers) for r in wrappers.collect()] == [2]
    for size in (32_000_000, 0):
        got = {r.page_id: r for r in extract_pages(frame, wrappers, broadcast_bytes=size).collect()}
        assert all(r.wrapped for r in got.values()) and got[3].text == wanted("thing3", 5)
        assert "item2 is a long story with many words" in got[12].text


def test_layouts_of_long_pages_have_wrappers(spark):
    """No <article>, no names, and every page longer than the bound: without a wrapper the house's own lines would stay in."""
    page = lambda t, n: "<body><div><p>Welcome to the house of pages</div><div><div><p>All of " + t + " at length</p>" + "".join(f"<p>part {k} of {t}" for k in range(n)) + "</div></div><div><p>write us</div>"
    wanted = lambda t, n: "\n".join([f"All of {t} at length", *(f"part {k} of {t}" for k in range(n))])
    for most, sizes in ((5, (20, 21, 22, 23)), (4000, (4010, 4011, 4012))):
        rows = [(i, f"http://h.example.com/{i}", page(f"thing{i}", n)) for i, n in enumerate(sizes)]
        frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        wrappers = induce_wrappers(frame, most_nodes=most)
        assert [len(r.wrappers or []) for r in wrappers.collect()] == [1]
        got = {r.page_id: r for r in extract_pages(frame, wrappers).collect()}
        for i, n in enumerate(sizes):
            assert got[i].wrapped and got[i].text == wanted(f"thing{i}", n)
            assert plain_text(read_page(rows[i][2])) != got[i].text
    # one short page of the layout is not enough to leave the long ones for
    mixed = spark.createDataFrame(rows[:1] + [(9, "http://h.example.com/9", page("short", 4))], frame.schema)
    assert sum(len(r.wrappers or []) for r in induce_wrappers(mixed, most_nodes=5).collect()) <= 1


def test_names_are_not_needed_for_slots(monkeypatch):
    pages = [PAGE.format(t=t) for t in ("Alpha", "Beta", "Gamma delta")]
    monkeypatch.setattr(dom, "NAMES", frozenset())
    text, wrapped = main_text(read_page(PAGE.format(t="Zeta")), Wrapper(induce(pages)))
    assert wrapped and text == WANT.format(t="Zeta")  # the readers' part is constant here, so it is template


def test_slot_and_text():
    pages = [PAGE.format(t=t) for t in ("Alpha", "Beta", "Gamma delta")]
    assert induce(pages[:1]) is None and induce([pages[0]] * 3) is None
    for t in ("Alpha", "Zeta"):
        assert main_text(read_page(PAGE.format(t=t)), Wrapper(induce(pages))) == (WANT.format(t=t), True)
    plain = lambda html: main_text(read_page(html), None)[0]
    assert plain("<p>a<p>b &am") == "a\nb &am"
    assert plain("<body>x<article>y</article>z") == "y"
    assert main_text(read_page("<body>x<article>y</article>z"), Wrapper(induce(pages))) == ("y", False)
    assert plain("a < b <p class='x>y'>c</p><").startswith("a < b\nc")
    assert plain("<p>" * 5000 + "deep") == "deep"
    assert plain("<form><div><article>all in a form</article></div></form>") == "all in a form"
    # two copies of an article with other adverts: nothing of it is template
    twins = [f"<body><div class=x>buy {k} now</div><div><p>one article that two pages share in all its words</div>" for k in range(2)]
    assert main_text(read_page(twins[0]), Wrapper(induce(twins)))[0] == "one article that two pages share in all its words"


@pytest.mark.parametrize("tag", ["div", "b", "span", "p", "ul"])
def test_deep_pages(tag):
    deep = [f"<{tag}>" * n + f"text {n}" for n in (5000, 4990, 1500)]
    assert [main_text(read_page(d), None)[0] for d in deep] == ["text 5000", "text 4990", "text 1500"]
    said = induce(deep)
    assert main_text(read_page(deep[1]), Wrapper(said) if said else None)[0] == "text 4990"


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a title=\"x>" * 90_000, "</b>" * 260_000, "<b><div>" * 5000 + "<i>" * 5000 + "</b>" * 200_000, "<" * 1_000_000, "<!--" * 250_000, "<script>" * 130_000, "<li>" * 250_000])
def test_broken_pages_take_no_longer_than_their_length(html):
    start = time.perf_counter()
    main_text(read_page(html), None)
    assert time.perf_counter() - start < 20


def test_extract(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(t=f"Title {i}")) for i in range(30)]
    rows += [(100, "http://one.example.com", PAGE.format(t="x")), (101, None, "<p>a</p>"), (102, "http://h0.example.com", None), (103, "http://h1.example.com", ""), (None, "http://h1.example.com", PAGE.format(t="no id"))]
    rows += [(5, "http://h1.example.com/5", PAGE.format(t="Title 5"))] * 50 + [(104, "http://h1.example.com", "<body>" + "<p>long text</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS layout", "4 AS id", "5 AS h")
    got = [(str(r.page_id), r.text, r.n_chars) for r in extract_pages(pages, induce_wrappers(pages)).collect()]
    want = [(str(i), WANT.format(t=f"Title {i}")) for i in [*range(30), *[5] * 50]] + [("100", WANT.format(t="x")), ("101", "a"), ("102", ""), ("103", ""), ("None", WANT.format(t="no id")), ("104", "\n".join(["long text"] * 20_000))]
    assert sorted(got) == sorted((k, t, len(t)) for k, t in want)
    empty = pages.limit(0)
    assert extract_pages(empty, induce_wrappers(empty)).count() == 0


def test_fixture_by_alignment_alone(spark, monkeypatch):
    """The article of every page of sf0.01, also with all furniture names switched off."""
    import re
    from html import unescape

    monkeypatch.setattr(dom, "NAMES", frozenset())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = lambda u: re.match(r"\w+://([^/?#]+)", u)[1]
    groups = {}
    for r in pages:
        groups.setdefault((host(r.url), html_wrap.layout_of(read_page(r.html))), []).append(r.html)
    wrong = 0
    for own in groups.values():
        said = induce(own[:8])
        for html in own if said else []:
            inner = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*)</article>", html, re.S)[1], flags=re.S)
            blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", "\0", inner)).split("\0")
            wrong += main_text(read_page(html), Wrapper(said))[0] != "\n".join(t for b in blocks if (t := " ".join(unescape(b).split())))
    assert wrong == 0
