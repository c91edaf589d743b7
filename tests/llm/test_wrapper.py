from __future__ import annotations

import random
import time

from stratagrid.llm import wrapper as W

SCHEMA = "page_id long, url string, html string, text string, host int, h string"
SHELL = """<!DOCTYPE html><html><head><title>t {i}</title><style>p{{}}</style><script>var a="</p><article>";</script></head>
<body><nav><a href=/>Home</a> <a href=/x>More</a></nav><div class="top-banner ad">Buy {i}</div>{main}
<div id="comments"><p>A reader wrote {i} long words about it, and wrote on and on</p></div><form>Name <input></form><aside>Other {i}</aside><footer>&copy; us {i}</footer></body></html>"""


def page(i, main):
    return SHELL.format(i=i, main=main)


def plain(i):
    return f"<div class=text><h1>Head {i}</h1><p>First &amp; <b>bold</b>\n  {i} text of this page, number {i * 7}<p>Second{i}<br>line &#233;{i}</div>"


def texts(source):
    return [t for _, t, _ in W.segments(W.parse(source))]


def test_parse_closes_what_html_closes():
    assert texts("<p>a<p>b<ul><li>c<li>d<ul><li>e</ul></ul><table><tr><td>f<td>g<tr><td>h</table></i>x<!-- y --><![CDATA[<z>]]><a title='>'>k</a><b") == ["a", "b", "c", "d", "e", "f", "g", "h", "x<z>k<b"]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 10) == ["deep"]
    assert texts('<a "' * 20000)
    # References end with their piece of text; scripts leave no gap, other marked elements one.
    assert texts("<p>&am<b>p</b>; a<script>x</script>b <i>c</i>d<button>no</button>e &lt;p&gt;") == ["&amp; ab cd e <p>"]


def test_varying_slots_are_content_and_constant_ones_template():
    pages = [page(i, plain(i).replace("</div>", "<p>All rights of this notice are ours</div>")) for i in range(5)]
    assert W.extract(pages[3], W.induce(pages)) == "Head 3\nFirst & bold 3 text of this page, number 21\nSecond3 line é3"
    assert W.extract(pages[3], W.induce(pages[:2])).endswith("All rights of this notice are ours")  # two pages say too little


def test_a_constant_text_goes_from_its_slot_alone():
    pages = [page(i, plain(i).replace("</div>", "<blockquote>{}</blockquote><p>Read on</div>".format("Read on" if i == 2 else f"Quote {i}"))) for i in range(5)]
    assert W.extract(pages[2], W.induce(pages)).split("\n")[-1] == "Read on" and W.extract(pages[2], W.induce(pages)).count("Read on") == 1


def test_what_varies_decides_without_article_elements_or_marks():
    """A box with no telling tag, class or id is found by what varies; unmarked constant and lesser boxes stay out."""
    body = "<div>Our shop</div><div><p>Tip {0}</p></div><section><h1>Head {0}</h1><p>The story of {0} goes on for a while, and then for {1} words more, until it ends</p><p>It ends at {0}</p></section><div>All of it is ours, for ever and a day</div>"
    pages = [f"<html><body>{body.format(i, i * i)}</body></html>" for i in range(6)]
    for i in (0, 5):
        assert W.extract(pages[i], W.induce(pages)) == f"Head {i}\nThe story of {i} goes on for a while, and then for {i * i} words more, until it ends\nIt ends at {i}"
    # A mark does not outweigh nearly all varying text; what readers wrote never counts.
    marked = [p.replace("<section>", "<section class='social issues'>").replace("<div><p>Tip", "<div class=comments><p>Tip") for p in pages]
    assert W.extract(marked[2], W.induce(marked)).startswith("Head 2\nThe story of 2")
    # The title beside the container is kept, lesser boxes are not; two layouts of one host each keep their own.
    beside = [f"<body><header><h1>Title {i}</h1></header><div><p>{'word ' * 30}{i}</p></div><div class=x>Note {i}</div></body>" if i % 2 else f"<body><div class=b><div class=c><p>{'other ' * 30}{i}</p></div></div></body>" for i in range(8)]
    assert W.extract(beside[3], W.induce(beside)) == "Title 3\n" + "word " * 30 + "3"
    assert W.extract(beside[4], W.induce(beside)) == "other " * 30 + "4"


def test_articles_headers_and_copies():
    main = "<article><header><h1>T {0}</h1><p>by me</p></header><p>Body {0}</p><div class='share'>tweet</div><footer>tags</footer><table><tr><td>x{0}<td>y{0}</table></article>"
    pages = [page(i, main.format(i)) for i in range(4)]
    w = W.induce(pages)
    assert W.extract(pages[2], w) == "T 2\nBody 2\nx2\ny2"
    near = [page(i, main.format(9)) for i in range(6)]  # copies but for what stands around the article
    assert W.extract(near[0], W.induce(near)) == "T 9\nBody 9\nx9\ny9"
    assert W.extract(near[0], W.induce([near[0]] * 5)) == "T 9\nBody 9\nx9\ny9"
    few = [page(i, f"<div class=text><h1>Head {i}</h1><p>The text of page {i} is one of its own, not a copy</p></div>") for i in range(6)]
    some = [page(i, "<div class=text><h1>Nine</h1><p>This text stands on four pages, with a list that no other has</p><ul><li>one of it<li>two of it</ul></div>") for i in range(4)]
    assert W.extract(some[1], W.induce(few + some)).endswith("one of it\ntwo of it")  # copies don't make their own slots constant
    assert W.extract("<html><body><p>Other page, other form, long enough</p></body></html>", w) == "Other page, other form, long enough"
    assert W.extract(None, w) == W.extract("", w) == W.extract("", None) == ""


def match(a, b):
    """Simple tree matching by its recurrence."""
    if a.sig != b.sig:
        return 0

    def rows(n, m):
        return 0 if not n or not m else max(rows(n - 1, m), rows(n, m - 1), rows(n - 1, m - 1) + match(a.kids[n - 1], b.kids[m - 1]))

    return 1 + rows(len(a.kids), len(b.kids))


def test_alignment_is_the_largest_order_keeping_match():
    rng = random.Random(4)

    def tree(depth):
        s = W.Slot(rng.choice("ab") if depth < 3 else "r", "div", 0, [1])
        s.kids = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return s

    for _ in range(60):
        a, b = tree(3), tree(3)
        weight, pairs = W.best_pairs(a, b, {})
        assert weight == match(a, b) and weight == 1 + sum(match(a.kids[i], b.kids[j]) for i, j in pairs)
        quick = W.aligned(a, b, {})
        assert weight == 1 + sum(match(a.kids[i], b.kids[j]) for i, j in quick)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(quick, quick[1:]))
    size = W.count(a)
    W.combine(a, W.slot_of(a.told()), True)
    assert W.count(a) == size and a.pages == 2  # a tree and itself: nothing is added


def test_many_siblings_are_few_slots():
    long = ["<body><dl>" + "".join(f"<dt>t{i} {k}</dt><dd>d{i} {k}</dd>" for k in range(10000)) + "</dl></body>" for i in range(2)]
    began = time.time()
    top = W.induce(long)
    assert W.extract(long[1], top).count("\n") == 19999 and time.time() - began < 10 and W.count(top) < 10
    names = [f"<body>{''.join(f'<div class=c{chr(97 + k % 26)}{chr(97 + k // 26)}><p>t{i} {k}</p></div>' for k in range(600))}</body>" for i in range(3)]
    top = W.induce(names)
    assert W.count(top) <= 2 * W.WIDEST and W.extract(names[2], top).split("\n") == [f"t2 {k}" for k in range(600)]


def test_pages(spark):
    rows = [(i, f"https://u@Host{i % 2}.org:80/p/{i}?q", page(i, plain(i)), "c", 1, "x") for i in range(40)] + [(100, None, page(7, plain(7)), "c", 1, "x"), (None, "https://one.org", page(8, plain(8)), None, 1, "x"), (102, "not a url", None, "c", 1, "x"), (103, "https://host1.org", "", "c", 1, "x"), (5, "https://host1.org/p/5?q", page(5, plain(5)), "c", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = W.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in (0, 5, 39):
        assert text[i] == f"Head {i}\nFirst & bold {i} text of this page, number {i * 7}\nSecond{i} line é{i}"
    assert text[100].startswith("Head 7\n") and text[None].startswith("Head 8\n") and text[102] == text[103] == ""
    assert W.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0
    # Templates that are not broadcast, and hosts dealt to several salts, change nothing.
    order = lambda rs: sorted(map(tuple, rs), key=str)
    assert order(W.extract_pages(df, broadcast_bytes=0, salted=7).collect()) == order(got)


def test_every_page_of_a_host_counts(spark):
    """A block that stands on few pages of many, in a slot of its own, is template all the same."""
    late = "<div class=foot-note><p>Prices as of today</p></div>"
    rows = [(i, f"https://a.org/{i}", f"<body><div><h1>Head {i}</h1><p>Story {i} is told in some words</p>{late if i >= 295 else ''}</div></body>") for i in range(300)]
    got = W.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Head {i}\nStory {i} is told in some words" for i in range(300)}
