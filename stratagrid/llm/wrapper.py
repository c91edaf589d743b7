"""HTML extraction by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching (Yang 1991);
what stays constant becomes template, what varies becomes content.

Every page is folded to a tree of slots (repeated siblings are one slot). The trees of all pages of a host are merged
into one template; merging is done in parts, on the executors, and holds one page and one template at a time. A slot
keeps how many pages have it, how much text it holds, and the texts that all of them share. A page's text comes from the
slots that vary, as its host's template says."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"']+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = frozenset("ul ol dl table article section div main body td th".split())
#: Elements that are never an article's text (menus, footers, forms, scripts, styles).
NEVER = frozenset("head script style title textarea noscript iframe xmp template nav footer aside form button select option menu dialog svg canvas object audio video label input".split())
#: Of these, those that leave no gap between the words around them.
NO_GAP = frozenset("script style template noscript".split())
#: Words of a class, id or role that mark what isn't the article; a slot that holds nearly all varying text counts all the same.
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar search contentinfo complementary masthead topbar skip".split())
#: Words that mark what readers wrote, which may be more than the article, or what isn't shown.
READERS = frozenset("comment comments discussion replies reply disqus hidden".split())
#: Words that make a header the article's own.
OWN = frozenset("article post entry story content".split())
#: Elements of text: all of one signature under a parent are one slot. Others are containers, told apart by their place.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote pre hr address figcaption summary".split())
#: Containers: where the way to the article goes through, and what may be left beside it.
BOXES = frozenset("html body div section main article center table tbody tr td th li ul ol dl header hgroup details fieldset figure nav footer aside form menu dialog".split())
MAIN = ("article", "main")
DEEPEST = 150
#: Slots under one parent; beyond, those of one tag are one slot. Bounds a template, whatever class names pages invent.
WIDEST = 64
#: Different pages that a slot must have before what they share counts as template.
LEAST_PAGES = 3
#: The longest texts of a page that tell it from others.
LONGEST = 3
#: The share of the varying text that a container must hold for what stands beside it to be left out.
HEAVY = 0.85
#: Slots that a worker holds before it hands on what it has merged, or forgets templates it has read.
HELD = 50_000


class Node:
    __slots__ = ("items", "off", "sig", "slot", "tag")

    def __init__(self, tag: str, sig: str, off: int) -> None:
        self.tag, self.sig, self.off = tag, sig, off
        self.items: list[str | Node] = []


def parse(page: str) -> Node:
    """The tree of a page. Ends of p, li, table cells and so on may be missing; strays are passed over; elements deeper
    than DEEPEST hang from that depth, with their text. Nodes have off 1 where a class marks them, 2 where they can't be
    the article's."""
    root = Node("", "", 0)
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].items.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCK and len(stack) > 1:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in HOLDS:
                    break
        if (over := CLOSES.get(tag)) is not None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in over:
                    del stack[k:]
                elif stack[k].tag in HOLDS and stack[k].tag not in over:
                    break
        sig, off = tag, 2 if tag in NEVER else 0
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                what, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
                if what in ("hidden", "aria-hidden"):
                    if what == "hidden" and tag not in MAIN or value == "true":
                        off = 2
                else:
                    words = re.split(r"[^a-z]+", value)
                    if tag not in ("html", "body", "article", "main"):
                        if not READERS.isdisjoint(words):
                            off = 2
                        elif not MARKS.isdisjoint(words) or "header" in words and OWN.isdisjoint(words):
                            off = max(off, 1)
                    if what != "id":
                        sig += "." + re.sub(r"\d+", "0", value)
        node = Node(tag, sig, off)
        stack[-1].items.append(node)
        if tag in RAW:
            stop = RAW_END[tag].search(page, at)
            at = stop.start() if stop else end
        if tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag != "hr":
            if len(stack) < DEEPEST:
                stack.append(node)
    return root


def segments(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, code points outside links) for every piece of text between the bounds of blocks, in page
    order. References are decoded piece by piece; white space becomes one space. What can't be the article's is left
    out, and of a header all but its headings."""
    out: list[tuple[Node, str, int]] = []
    line: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        if line:
            if text := " ".join("".join(line).split()):
                out.append((owner, text, max(0, len(text) - linked)))
            line.clear()
        linked = 0

    def walk(node: Node, owner: Node, heads: bool, link: bool) -> None:
        nonlocal linked
        for x in node.items:
            if isinstance(x, str):
                if not heads:
                    text = entities.unescape(x)
                    line.append(text)
                    if link:
                        linked += len(text.strip())
            elif x.tag in BLOCK:
                flush(owner)
                if x.off < 2:
                    walk(x, x, (heads or x.tag == "header") and x.tag not in ("h1", "h2", "h3"), link)
                flush(x)
            elif x.off or x.tag == "br":
                if x.tag not in NO_GAP:
                    line.append(" ")
            else:
                walk(x, owner, heads, link or x.tag == "a")

    walk(root, root, False, False)
    flush(root)
    return out


class Slot:
    """A place in a page or template: pages that have it, up to LEAST_PAGES of them by hash, code points of its own text
    outside links in all pages, the texts that all these pages have there (hash, code points), and the slots below it."""

    __slots__ = ("kids", "off", "pages", "plain", "same", "sig", "some", "tag", "to", "wide")

    def __init__(self, sig: str, tag: str, off: int, some: list[int]) -> None:
        self.sig, self.tag, self.off, self.some = sig, tag, off, some
        self.pages, self.plain, self.wide = 1, 0, False
        self.same: dict[int, int] = {}
        self.kids: list[Slot] = []
        self.to: Slot | None = None

    def told(self) -> list:
        return [self.sig, self.tag, self.off, self.some, self.pages, self.plain, self.wide, list(self.same.items()), [k.told() for k in self.kids]]


def slot_of(told: list) -> Slot:
    s = Slot(*told[:4])
    s.pages, s.plain, s.wide = told[4:7]
    s.same, s.kids = dict(map(tuple, told[7])), [slot_of(k) for k in told[8]]
    return s


def count(s: Slot) -> int:
    """Slots of a tree, and one for every eight texts, which take about as much memory."""
    return 1 + len(s.same) // 8 + sum(map(count, s.kids))


def best_pairs(a: Slot, b: Slot, memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two slots of the same signature: the number of slots in the largest match of their trees
    that keeps parents and order, and which kids it pairs. No parent has over 2 * WIDEST kids. Each pair of slots is
    compared once."""
    at = (id(a), id(b))
    if at in memo:
        return memo[at]
    wide = a.wide or b.wide
    one, two = ([k.tag if wide else k.sig for k in s.kids] for s in (a, b))
    n, m = len(one), len(two)
    w = [[best_pairs(a.kids[i], b.kids[j], memo)[0] if one[i] == two[j] else 0 for j in range(m)] for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + w[i][j] if w[i][j] else 0)
    i = j = 0
    pairs = []
    while i < n and j < m:
        if w[i][j] and best[i][j] == best[i + 1][j + 1] + w[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    memo[at] = 1 + best[0][0], pairs
    return memo[at]


def aligned(a: Slot, b: Slot, memo: dict) -> list[tuple[int, int]]:
    """The kids that ``best_pairs`` pairs. Where each signature stands once on both sides and in one order, all that are
    common are paired without a comparison: no match is larger."""
    wide = a.wide or b.wide
    one, two = ([k.tag if wide else k.sig for k in s.kids] for s in (a, b))
    if one == two and len(set(one)) == len(one):
        return [(k, k) for k in range(len(one))]
    place = {s: i for i, s in enumerate(one)}
    if len(place) == len(one) and len(set(two)) == len(two):
        pairs = [(place[s], j) for j, s in enumerate(two) if s in place]
        if all(p[0] < q[0] for p, q in zip(pairs, pairs[1:])):
            return pairs
    return best_pairs(a, b, memo)[1]


def combine(a: Slot, b: Slot, across: bool, memo: dict | None = None) -> None:
    """Adds b's tree to a's. ``across``: they come from different pages, and what both have is what they share; else they
    are siblings of one page, and have what either has. Kids of b without a counterpart get a place of their own."""
    memo = {} if memo is None else memo
    pairs = aligned(a, b, memo)
    if across:
        a.pages += b.pages
        a.some = sorted({*a.some, *b.some})[:LEAST_PAGES]
        a.same = {h: n for h, n in a.same.items() if h in b.same}
    else:
        a.same.update(b.same)
    a.plain += b.plain
    a.off = min(a.off, b.off)
    b.to = a
    met, taken = [(a.kids[i], b.kids[j]) for i, j in pairs], {j: i for i, j in pairs}
    if len(pairs) < len(b.kids):
        put, shift = 0, 0
        for j, kid in enumerate(b.kids):
            if j in taken:
                put = taken[j] + shift + 1
            else:
                a.kids.insert(put, kid)
                put, shift = put + 1, shift + 1
    for x, y in met:
        combine(x, y, across, memo)
    a.wide = a.wide or b.wide
    if len(a.kids) > WIDEST or a.wide:
        widen(a, across)


def widen(s: Slot, across: bool) -> None:
    """Makes the kids of one tag one slot; what they share is then what all share."""
    s.wide = True
    kept: dict[str, Slot] = {}
    for k in s.kids:
        if k.tag in kept:
            combine(kept[k.tag], k, across)
            kept[k.tag].pages = min(kept[k.tag].pages, s.pages)
        else:
            kept[k.tag] = k
    s.kids = list(kept.values())


def fold(root: Node, pieces: list[tuple[Node, str, int]], page: int) -> Slot:
    """A page's tree of slots; each block element learns its slot. Siblings of one signature are one slot if they are
    elements of text, neighbours, or three or more."""
    import xxhash

    def build(node: Node) -> Slot:
        s = node.slot = Slot(node.sig, node.tag, node.off, [page])
        found: list[Node] = []
        inner(node, found)
        if found:
            times: dict[str, int] = {}
            for x in found:
                times[x.sig] = times.get(x.sig, 0) + 1
            first: dict[str, Slot] = {}
            for x in found:
                kid = build(x)
                if s.kids and s.kids[-1].sig == x.sig:
                    combine(s.kids[-1], kid, False)
                elif (x.tag in TEXT or times[x.sig] > 2) and x.sig in first:
                    combine(first[x.sig], kid, False)
                else:
                    s.kids.append(kid)
                    first[x.sig] = kid
            if len(s.kids) > WIDEST:
                widen(s, False)
        return s

    def inner(node: Node, found: list[Node]) -> None:
        """The blocks right below a node, through inline elements."""
        for x in node.items:
            if not isinstance(x, str):
                if x.tag in BLOCK:
                    if x.off < 2:
                        found.append(x)
                elif not x.off:
                    inner(x, found)

    top = build(root)
    for owner, text, plain in pieces:
        s = place(owner)
        s.same[xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))] = plain
        s.plain += plain
    return top


def place(node: Node) -> Slot:
    s = node.slot
    while s.to is not None:
        s = s.to
    return s


def tree_of(page: str) -> tuple[Node, list[tuple[Node, str, int]], Slot]:
    """A page's elements, texts and slots. Pages count as different by their LONGEST texts: copies that differ in what
    stands around the article are one page."""
    import xxhash

    root = parse(page)
    pieces = segments(root)
    longest = sorted({text for _, text, _ in pieces}, key=lambda x: (-len(x), x))[:LONGEST]
    return root, pieces, fold(root, pieces, xxhash.xxh64_intdigest("\n".join(longest).encode("utf-8", "surrogatepass")))


def constant(s: Slot) -> dict[int, int]:
    """What all pages of a slot share, if LEAST_PAGES different ones have it."""
    return s.same if len(s.some) >= LEAST_PAGES else {}


def copies(top: Slot) -> bool:
    """Whether pages of a template are copies of one another: they share more text than varies. Marked slots don't count,
    unless they hold more text than all others."""

    def sums(s: Slot, marked: bool) -> tuple[int, int]:
        shared, every = s.pages * sum(constant(s).values()), s.plain
        for k in s.kids:
            if marked or not k.off:
                x, y = sums(k, marked)
                shared, every = shared + x, every + y
        return shared, every

    shared, every = sums(top, False)
    whole = sums(top, True)
    if whole[1] > 2 * every:
        shared, every = whole
    return 2 * shared > every


def induce(pages: list[str]) -> Slot | None:
    """The template of some pages; None without any."""
    top = None
    for page in pages:
        found = tree_of(page)[2]
        if top is None:
            top = found
        else:
            combine(top, found, True)
    return top


def extract(page: str | None, template: Slot | None) -> str:
    """The article's text: the blocks of the page's content slots, in page order, but those that are template.

    The page's tree is aligned with the template. A slot weighs as much as the text that varies there, on average over
    its pages. From the root, the way goes to the container that holds HEAVY of all weight, if nothing but other
    containers and a varying h1 (which is kept) stands beside it; never below an article or main element. A slot that a
    class marks weighs nothing, unless it has three times the weight of all others. Without a template of two different
    pages, the page's own text weighs, and an article or main element with text is the container."""
    root, pieces, own = tree_of(page or "")
    match: dict[int, Slot] = {}
    if template is not None and len(template.some) > 1:
        memo: dict = {}

        def pair(a: Slot, b: Slot) -> None:
            match[id(b)] = a
            for i, j in aligned(a, b, memo):
                pair(a.kids[i], b.kids[j])

        pair(template, own)
    alone = not match
    same = not alone and not copies(template)
    shared = lambda s: constant(match[id(s)]) if same and id(s) in match else {}
    weights: dict[int, float] = {}

    def weigh(s: Slot) -> float:
        t = match.get(id(s), s)
        weights[id(s)] = max(0.0, t.plain / t.pages - sum(shared(s).values())) + sum(weigh(k) * (not k.off) for k in s.kids)
        return weights[id(s)]

    total = weigh(own)
    marked: list[Slot] = []

    def seek(s: Slot, wanted: Callable[[Slot], bool]) -> None:
        for k in s.kids:
            if wanted(k):
                marked.append(k)
            else:
                seek(k, wanted)

    seek(own, lambda k: k.off == 1)
    for k in marked:
        if weights[id(k)] > 3 * total and weights[id(k)] > 0:
            k.off, total = 0, weigh(own)
            break
    now, heads = own, []
    if alone:
        marked.clear()
        seek(own, lambda k: k.off or k.tag in MAIN and weights[id(k)] > 0)
        now = max((k for k in marked if not k.off), key=lambda k: weights[id(k)], default=own)
    box = lambda k: k.tag in BOXES and not (k.tag in TEXT and not k.kids)
    while now.tag not in MAIN:
        live = [k for k in now.kids if not k.off and weights[id(k)] > 0]
        heavy = max(filter(box, live), key=lambda k: weights[id(k)], default=None)
        if heavy is None or weights[id(heavy)] < HEAVY * total:
            break
        if any(k.tag != "h1" and not box(k) for k in live) or weights[id(now)] - sum(weights[id(k)] for k in live) > 1e-9:
            break
        marked.clear()
        for k in live:
            if k.tag == "h1":
                marked.append(k)
            elif k is not heavy:
                seek(k, lambda h: h.tag == "h1" and not h.off and weights[id(h)] > 0)
        heads += marked
        now = heavy
    inside: set[int] = set()

    def enter(s: Slot) -> None:
        inside.add(id(s))
        for k in s.kids:
            if not k.off:
                enter(k)

    for s in (*heads, now):
        enter(s)
    if not same:
        return "\n".join(text for owner, text, _ in pieces if id(place(owner)) in inside)
    import xxhash

    return "\n".join(text for owner, text, _ in pieces if id(s := place(owner)) in inside and xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) not in shared(s))


def host_of(url: str) -> F.Column:
    """The lower-case host of an address, null without one."""
    found = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(found, F.lit(""))


def templates(pages: DataFrame, salts: int = 64) -> DataFrame:
    """(host, pages, template) of every host of ``pages`` (host, body): the trees of all its pages, merged. Each task merges
    what it reads and hands on one tree for each host it meets; these are merged in two steps, first within ``salts``
    parts of a host, each in the order of the tasks that made them. One tree for a host is held at a time there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, turn = TaskContext.get().partitionId(), {}, 0, 0

        def told() -> pa.RecordBatch:
            rows = [(h, part % salts, part, turn, s.pages, json.dumps(s.told(), separators=(",", ":"))) for h, s in made.items()]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tree = tree_of(page.as_py())[2]
                if host in made:
                    combine(made[host], tree, True)
                else:
                    made[host] = tree
                held += count(tree)
                if held > HELD:
                    held = sum(map(count, made.values()))
                    if 2 * held > HELD:
                        yield told()
                        made, held, turn = {}, 0, turn + 1
        if made:
            yield told()

    names = ["host", "salt", "part", "turn", "pages", "template"]
    schema = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("part", pa.int64()), ("turn", pa.int64()), ("pages", pa.int64()), ("template", pa.string())])
    kinds = "host string, salt int, part long, turn long, pages long, template string"

    def merge(keys: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, top = None, None

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([dict(zip(names, (*now[:2], 0, 0, top.pages, json.dumps(top.told(), separators=(",", ":"))), strict=True))], schema)

            for b in batches:
                for row in b.to_pylist():
                    at = (row["host"], row["salt"] if keys == 2 else 0)
                    tree = slot_of(json.loads(row["template"]))
                    if at == now:
                        combine(top, tree, True)
                        continue
                    if now is not None:
                        yield told()
                    now, top = at, tree
            if now is not None:
                yield told()

        return run

    found = pages.mapInArrow(read, kinds)
    found = found.repartition("host", "salt").sortWithinPartitions("host", "salt", "part", "turn").mapInArrow(merge(2), kinds)
    found = found.repartition("host").sortWithinPartitions("host", "salt").mapInArrow(merge(1), kinds)
    return written(found.select("host", "pages", "template"))


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", broadcast_bytes: int = 8 << 20, salted: int = 10_000) -> DataFrame:
    """One row for each row of df: key, url, text, n_chars (code points), over whole pages.

    A host's template is merged from all its pages; every page is aligned with it. Pages whose url is null or has no
    host, and the page of a host of one page, stand alone. Null and empty pages give an empty text. Repeated rows and
    keys each have a row, and add no different page to a template. Other columns are not carried, whatever their names.
    Empty table: no rows. Templates (one a host) are broadcast up to ``broadcast_bytes`` in sum; beyond, pages are dealt
    by host and, for each ``salted`` pages of a host, a salt, and meet its template there."""
    pages = df.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"), host_of(url).alias("host"))
    known = templates(pages.where(F.col("host").isNotNull() & (F.col("body") != "")).select("host", "body"))
    total = known.agg(F.sum(F.length("template") + F.length("host") + 64).alias("n")).first().n or 0
    if total <= broadcast_bytes:
        met = pages.join(F.broadcast(known), "host", "left")
    else:
        parts = F.ceil(F.col("pages") / F.lit(salted)).cast("int")
        dealt = known.select("host", "template", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        sizes = known.where(parts > 1).select(F.col("host").alias("_host"), parts.alias("_parts"))  # pages / salted hosts at most
        salt = F.when(F.col("host").isNull(), -1 - F.pmod(F.xxhash64("body"), F.lit(1 << 20))).otherwise(F.pmod(F.xxhash64("id", "url"), F.coalesce("_parts", F.lit(1)))).cast("int")
        met = pages.join(sizes.hint("broadcast") if sizes.count() <= salted else sizes, F.col("host") == F.col("_host"), "left").withColumn("salt", salt).join(dealt, ["host", "salt"], "left")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Slot] = {}
        held = 0
        for b in batches:
            texts = []
            for page, template in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                top = None
                if template is not None:
                    if (top := memo.get(template)) is None:
                        top = slot_of(json.loads(template))
                        held += count(top)
                        if held > HELD:
                            memo.clear()
                            held = count(top)
                        memo[template] = top
                texts.append(extract(page.as_py(), top))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    return met.select("id", "url", "body", "template").mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", key)


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
