"""Main text: parts that never are, malformed pages, the style tree's choice, odd inputs."""

import math
import random
from collections import Counter

from sievespark.llm import html_text as h

PAGES = "page_id bigint, url string, html string, host string, text string, low string"


def test_parts_that_are_never_main_text():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="ad-free"><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>menu</a></ul></nav><div id="cookie-notice">cookies</div><div class="ad">buy</div>
    <main class="has-sidebar"><header><h1>Title &amp; more</h1></header><p>One<br>two<script>var t="</p>";</script> <b>three</b>
    <ul><li>a<li>b</ul><form>ask</form><aside>side</aside><!-- <p>no</p> --><section class="comments"><article class="comment"><p>hi</article></section>
    <p>end &nbsp; &#x41;<table><tr><td>1<td>2</table></main><footer>&copy; f</footer></body></html>"""
    assert h.main_text(page) == "Title & more\nOne two three\na\nb\nend A\n1\n2"


def test_inline_parts_are_left_out():
    page = '<article><p>one <span class="share-bar">Tweet <span>this</span></span> two <b hidden>x</b>three<a class="ad">never closed<p>four <i>five</i></article>'
    assert h.main_text(page) == "one two three\nfour five"


def test_malformed_pages():
    assert h.main_text("") == ""
    assert h.main_text("plain &lt; text & more\n\n x") == "plain < text & more x"
    assert h.main_text('<article><p>cut <a href="x') == "cut"
    assert h.main_text("<article><p><b>one<br><p>two</p></article></div>tail") == "one\ntwo"
    assert h.main_text("<article>a < b <3</article>") == "a < b <3"
    assert h.main_text("<article><p>x<script>never ends") == "x"
    for deep in ("<div>x" * 30_000, "<p>" * 50_000, "<" * 100_000, '<a "' * 30_000, "</p>" * 50_000):
        h.main_text(deep)


def test_style_tree_drops_what_all_pages_of_a_host_show(spark):
    page = lambda i: f'<body><div class="top">Welcome to our place</div><div class="body"><p>story {i} of many</p></div><div class="end">All rights are ours</div></body>'
    pages = [(i, f"http://Big.example:80/{i}", page(i), "clash", "clash", "clash") for i in range(12)]
    pages += [(100 + i, f"https://u@few.example/{i}", page(i), "", "", "") for i in range(2)]
    pages += [(200 + i, f"http://one.example/{i}", "<body><article><p>the same article</p></article></body>", "", "", "") for i in range(12)]
    pages += [(400 + i, None, page(0), "", "", "") for i in range(9)]
    pages += [(300, None, page(7), None, None, None), (301, "no url", None, "", "", ""), (302, "http://Big.example/x", "", "", "", ""), pages[0]]
    got = [(x.page_id, x.text) for x in h.extract(spark.createDataFrame(pages, PAGES)).collect()]
    assert len(got) == len(pages)
    by = dict(got)
    assert all(by[i] == f"story {i} of many" for i in range(12))
    assert by[100] == "Welcome to our place\nstory 0 of many\nAll rights are ours"
    assert all(by[200 + i] == "the same article" for i in range(12))
    assert by[301] == by[302] == ""
    assert all(by[400 + i] == by[100] for i in range(9))


def test_importance_is_normalised_entropy(spark):
    nodes = [("a", False, 1, 10, 4), ("a", False, 2, 20, 1), ("a", False, 2, 21, 1), ("a", False, 2, 22, 1), ("a", False, 2, 23, 1), ("b", False, 1, 5, 1)]
    leaves = [("a", True, leaf, 50 + k, 9) for leaf, many in ((0, 4), (7, 4), (8, 2), (9, 1)) for k in range(many)] + [("b", True, 0, 1, 1), ("b", True, 7, 1, 1)]
    counts = spark.createDataFrame(nodes + leaves, "host string, leaf boolean, node bigint, shown bigint, n bigint")
    got = {(x.host, x.node): round(x.importance, 6) for x in h.importance(counts).collect()}
    log = math.log
    assert got == {("a", 1): round((log(5) - 4 * log(4) / 5) / log(5), 6), ("a", 2): 1.0, ("b", 1): 1.0}
    got = {(x.host, x.node): round(x.importance, 6) for x in h.leaf_importance(counts).collect()}
    assert got == {("a", 7): round(1 - log(4) / log(5), 6), ("a", 8): round(1 - log(2) / log(5), 6)}


def planted_site(pages, seed):
    """Boilerplate in unnamed parts: constant divs and paragraphs inside the article and around it, some on few pages only."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 7)))
    for i in range(pages):
        story = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(r.randint(2, 5))]
        quote = ["a line that some articles quote"] if i % 3 == 0 else []
        yield (
            i,
            f"http://planted{seed}.example/{i}",
            "<body><div class='x1'>Welcome back, friend</div><article><h1>" + story[0] + "</h1><p>Written by our staff for you</p>"
            + "".join(f"<p>{x}</p>" for x in story[1:] + quote) + f"<div><div>Read in three minutes</div><div>{word()} and {word()}</div></div><p>Thank you for reading on</p></article><div>All rights are ours</div></body>",
        ), "\n".join(story + quote)


def low_by_hand(pages):
    """The nodes and leaves of one host that go, by plain counting."""
    shown, beside, all_texts = {}, {}, set()
    for page in pages:
        _, nodes, found = h.parse(page)
        longest = sorted({*found.values()}, key=lambda t: (len(t), h.xxhash.xxh64_intdigest(t)))
        all_texts.add(longest[-1])
        for leaf, text in found.items():
            beside.setdefault(leaf, set()).add(next((t for t in reversed(longest) if t != text), None))
        for node, parts in nodes.items():
            shown.setdefault(node, []).append(tuple(parts))
    low = set()
    for node, things in shown.items():
        every = [n for n in Counter(things).values()] + [1] * h.PRIOR_PAGES
        share = [n / sum(every) for n in every]
        if -sum(p * math.log(p) for p in share) / math.log(sum(every)) < h.LEAST_IMPORTANCE:
            low.add(node)
    return low | {x for x, n in beside.items() if len(n) > 1 and 1 - math.log(len(n)) / math.log(max(len(all_texts), len(n)) + h.PRIOR_PAGES) < h.LEAST_OF_BLOCK}


def test_unnamed_boilerplate_inside_the_article_goes(spark):
    site = list(planted_site(60, 1))
    small = list(planted_site(4, 2))
    table = spark.createDataFrame([(*row, "", "", "") for row, _ in site] + [(1000 + row[0], *row[1:], "", "", "") for row, _ in small], PAGES)
    got = {x.page_id: x.text.split("\n") for x in h.extract(table).collect()}
    for (i, _, _), want in site:
        assert [x for x in got[i] if " and " not in x] == want.split("\n")
    for (i, _, _), want in small:
        assert set(want.split("\n")) < set(got[1000 + i]) and "Thank you for reading on" in got[1000 + i]
    for group, shift in ((site, 0), (small, 1000)):
        low = low_by_hand([row[2] for row, _ in group])
        assert all(h.main_text(row[2], low).split("\n") == got[shift + row[0]] for row, _ in group)


def test_an_article_at_many_addresses_with_few_edits_keeps_its_text(spark):
    pages = [(i, f"http://one.example/{i}", f"<article><h1>Edition {i}</h1>" + "".join(f"<p>The same long paragraph number {k} of the story</p>" for k in range(9)) + "</article>", "", "", "") for i in range(80)]
    got = {x.page_id: x.text for x in h.extract(spark.createDataFrame(pages, PAGES)).collect()}
    assert all(got[i].startswith(f"Edition {i}\nThe same") and got[i].count("\n") == 9 for i in range(80))


def test_stray_quotes_lose_no_text():
    assert h.main_text("<article><p class=it's>Hello one</p><p>World two</p></article>") == "Hello one\nWorld two"
    assert h.main_text("<article><p><a title=Don't>Hello</a> one</p><p>World two</p></article>") == "Hello one\nWorld two"
    assert h.main_text('<p title="5" tall">Hello</p><p>World</p>') == "Hello\nWorld"
    assert h.main_text('<p data-x = "a > b" class=\'y\'>Hello</p><p a="b"c>World</p>') == "Hello\nWorld"
    assert h.main_text('<a href=x?y="z>one</a> two <img alt="2 > 1"> three') == "one two three"
    assert h.main_text('<p =">Hello</p><!--><p>a</p><!-- x --!><p>b</p></ x><p>c') == "Hello\na\nb\nc"


def test_a_name_of_several_words_is_no_menu_by_one_of_them():
    for name in ("share-price", "related-work", "ad-hoc", "widget", "skip-first", "comment-free", "social-history", "notice-period"):
        assert h.main_text(f'<article><p>one</p><h2 id="{name}">two</h2><p class="{name}">three</p></article>') == "one\ntwo\nthree"
    for name in ("share", "share-buttons", "related-posts", "cookie_banner", "ad-slot-2", "sidebar-widget", "newsletter-form", "skip-link"):
        assert h.main_text(f'<article><p>one</p><div class="x {name}">two</div></article>') == "one"


def tags_by_states(page):
    """Where tags end, character by character through the states that HTML gives a tag; comments are not looked at."""
    out, at = [], 0
    while (at := page.find("<", at)) >= 0:
        i = at + 1 + (page[at + 1 : at + 2] == "/")
        if not page[i : i + 1].isalpha():
            at += 1
            continue
        state, quote = "tag", ""
        while i < len(page):
            c = page[i]
            if state == "quoted":
                state = "between" if c == quote else state
            elif c == ">":
                break
            elif state == "value" and not c.isspace():
                state, quote = ("quoted", c) if c in "\"'" else ("bare", "")
            elif state == "bare":
                state = "between" if c.isspace() else state
            elif state in ("tag", "name", "between", "after") and (c.isspace() or c == "/"):
                state = "after" if state in ("name", "after") and c != "/" else "between"
            elif c == "=" and state in ("name", "after"):
                state = "value"
            elif state in ("between", "after"):
                state = "name"
            i += 1
        out.append((at, min(i + 1, len(page))))
        at = out[-1][1]
    return out


def test_tags_end_where_a_browser_ends_them():
    r = random.Random(9)
    for _ in range(20_000):
        page = "".join(r.choice(["<b", "<p ", "</p", ">", " ", "=", '"', "'", "/", "a", "x=", "\n", "="]) for _ in range(r.randint(1, 14)))
        got = [m.span() for m in h._TOKEN.finditer(page) if m[2]]
        assert got == tags_by_states(page), page


def test_a_page_whose_article_is_mostly_boilerplate_loses_it(spark):
    """No share of lost text makes a page keep what all pages of its host show."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(5))
    same = "".join(f"<p>Paragraph {k} of the terms that stand on every page of this place, at some length</p>" for k in range(6))
    pages = [(i, f"http://terms.example/{i}", f"<article><p>{' '.join(word() for _ in range(30))}</p>{same}</article>", "", "", "") for i in range(60)]
    got = [x.text for x in h.extract(spark.createDataFrame(pages, PAGES)).collect()]
    assert all("\n" not in t and len(t.split()) == 30 for t in got)


def test_very_long_page(spark):
    long = "<article>" + "".join(f"<p>line {i} of a very long page</p>" for i in range(60_000)) + "</article>"
    got = h.extract(spark.createDataFrame([(1, "http://l.example/", long, "", "", "")], PAGES)).first()
    assert got.text.count("\n") == 59_999


def test_shuffled_way_gives_the_same(spark, monkeypatch):
    page = lambda i: f'<body><div class="top">Welcome</div><div class="body">story {i}</div></body>'
    table = spark.createDataFrame([(i, "http://big.example/", page(i), "", "", "") for i in range(20)], PAGES)
    want = sorted(map(tuple, h.extract(table).collect()))
    monkeypatch.setattr(h, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, h.extract(table).collect())) == want


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0
