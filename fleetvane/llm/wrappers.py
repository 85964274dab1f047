"""Operator 2: main text of HTML pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over a page's tokens: elements and text slots in order, each of which may be
optional or repeated, and repeated groups of them. A page alone is one: runs of alike elements are folded into repeated
ones, repeated sequences into groups. Two wrappers are aligned along their longest common sequence of elements; where they
mismatch, what only one of them has becomes optional. Pages of one structure are one wrapper. A host's different ones are
aligned in groups that a hash of their own deals out, in sorted order, then the groups' wrappers in the same way, so that
the result depends on the pages alone and not on how they lie in files and tasks.

All pages are then parsed by their host's wrapper, and each text is counted at its place in it. Text that every page of a
host has in the same place, while other places differ, is template text; what differs is a slot. Main text is what stands
in the slots of the article elements (else of the main element, else of the body). Elements that are boilerplate by their
name, role or class are left out even where their text differs from page to page, as adverts and reader comments do.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvane.llm.common import written

#: Wrappers of up to so many bytes in all are broadcast to the pages; more are joined by a salted shuffle.
MOST_BROADCAST_BYTES = 32 << 20
SALTS = 16
#: Wrappers of a host that are aligned in one go; items of a level before it is generalised; period of groups.
GROUP, MOST_ITEMS, MOST_PERIOD = 64, 64, 8
#: Pages of a host from which text can be told to be the template's.
LEAST_PAGES = 5
#: Elements nested deeper than this count as lying side by side; their text is kept.
MOST_DEPTH = 150
MAIN_TEXT = "page_id long, url string, text string, n_chars long"

#: Fixed values of HTML: elements without an end tag, with raw text, within a line; end tags that a start tag implies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
BOUNDS = frozenset("html body table ul ol dl select article section div main aside nav button object template".split())
#: Elements that a class or id alone never makes boilerplate, nor what holds one of them.
KEPT = frozenset("html body main article".split())
#: What readers' comments are called; an article inside such an element, or called so itself, is a comment.
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Words beside those of boilerplate in a class of several words; with any other word it isn't boilerplate.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box button buttons column container content cta desktop fixed footer global group header icon icons inner item items label left link links list main middle mobile module outer page panel placeholder primary "
    "right row secondary section site slot small sticky tag tags text title toggle top unit view wrap wrapper".split()
)
#: What boilerplate is called.
BOILERPLATE_TAGS = frozenset("nav header footer aside form script style noscript template button select option textarea iframe object embed svg canvas dialog menu head title noembed noframes input".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets header masthead topbar footer "
    "cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus replies reply respond search pagination pager toolbar".split()
)
_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>""", re.DOTALL)
_name = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_attribute = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_words, _digits = re.compile(r"[A-Za-z]+").findall, re.compile(r"\d+")


class Item:
    """A token of a wrapper. label: an element's name and class, "#" for text, "*" for any element, else a group's items."""

    __slots__ = ("label", "optional", "repeated", "items", "boilerplate", "source")

    def __init__(self, label: str, items: list[Item] | None = None, source: str | None = None):
        self.label, self.items, self.source = label, items or [], source
        self.optional = self.repeated = self.boilerplate = False


def _called(names: list[str], words: frozenset[str]) -> bool:
    """Whether a class or id is one of these words, alone or with neutral ones or sizes (sm, xl, x)."""
    for name in names:
        parts = {w.lower() for w in _words(name)}
        if not parts.isdisjoint(words) and all(len(w) < 3 for w in parts - words - BOILERPLATE_WORDS - NEUTRAL_WORDS):
            return True
    return False


@lru_cache(maxsize=20_000)
def _element(tag: str) -> tuple[str, str, bool, bool, bool]:
    """Name, label, whether it is boilerplate, whether only its class or id says so, and whether it holds comments, of a start tag."""
    start = _name.match(tag)
    name, found = start[1].lower(), {}
    for m in _attribute.finditer(tag, start.end()):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    comments = name not in ("html", "body", "main") and _called(names, COMMENT_WORDS)
    boilerplate = name in BOILERPLATE_TAGS or "hidden" in found or found.get("role", "").lower() in BOILERPLATE_ROLES or comments
    called = not boilerplate and name not in KEPT and _called(names, BOILERPLATE_WORDS)
    marks = _digits.sub("0", ".".join(sorted(names)))
    return name, f"{name}.{marks}" if marks else name, boilerplate or called, called, comments


def parse(page: str) -> list[Item]:
    """The page's elements and texts in order; end tags that are left out are put in."""
    root: list[Item] = []
    stack: list[tuple[str, list[Item], Item | None, bool]] = [("", root, None, False)]
    at, size = 0, len(page)

    def say(text: str) -> None:
        into = stack[-1][1]
        if text and into and into[-1].label == "#":
            into[-1].source += text
        elif text:
            into.append(Item("#", source=text if not text.isspace() else " "))

    def close(names: tuple[str, ...], bounds: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in bounds:
                return

    for m in _token.finditer(page):
        if m.start() < at:
            continue
        say(page[at : m.start()])
        at, tag = m.end(), m[0]
        if tag[1] in "!?":
            continue
        if tag[1] == "/":
            name = _name.match(tag)[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        name, label, boilerplate, called, comments = _element(tag)
        if name in CLOSES_P:
            close(("p",), BOUNDS)
        if name in CLOSES:
            for _ in CLOSES[name]:
                close(CLOSES[name], BOUNDS - frozenset(CLOSES[name]))
        item = Item(label)
        item.boilerplate, comments = boilerplate, comments or stack[-1][3]
        if name in KEPT and not comments:
            for _, _, holder, _ in stack:
                if holder:
                    holder.boilerplate = False
        stack[-1][1].append(item)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not tag.endswith("/>") and len(stack) < MOST_DEPTH:
            stack.append((name, item.items, item if called else None, comments))
    say(page[at:])
    return root


def _key(item: Item) -> str:
    return item.label if item.label != "()" else f"({','.join(map(_key, item.items))})"


def merge(a: Item, b: Item) -> Item:
    """One item for two of the same label."""
    out = Item(a.label, align(a.items, b.items) if a.items or b.items else None)
    out.optional, out.repeated, out.boilerplate = a.optional or b.optional, a.repeated or b.repeated, a.boilerplate or b.boilerplate
    return out


def _maybe(item: Item) -> Item:
    item.optional = True
    return item


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of both sequences: common items merged, others optional."""
    if not a or not b:
        return [_maybe(x) for x in a or b]
    ka, kb = list(map(_key, a)), list(map(_key, b))
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    ka, kb = list(map(_key, a)), list(map(_key, b))
    if len(a) * len(b) > MOST_ITEMS**2 * 4:
        return _any_order(a + b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if ka[i] == kb[j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_maybe(a[i]))
            i += 1
        else:
            out.append(_maybe(b[j]))
            j += 1
    out += [_maybe(x) for x in a[i:] + b[j:]]
    out = fold(out)
    return out if len(out) <= MOST_ITEMS else _any_order(out)


def _grouped(a: list[Item], b: list[Item]) -> list[Item]:
    """a, with sequences that a group of b repeats put into such a group."""
    for group in (x for x in b if x.label == "()"):
        want, keys, out, i = [_key(x) for x in group.items], list(map(_key, a)), [], 0
        while i < len(a):
            if keys[i : i + len(want)] == want:
                made = Item("()", a[i : i + len(want)])
                made.repeated = True
                out.append(made)
                i += len(want)
            else:
                out.append(a[i])
                i += 1
        a = out
    return a


def _any_order(items: list[Item]) -> list[Item]:
    """(a? b? c?)+ of the items' kinds: accepts them in any order. With too many kinds, classes are dropped; then anything is accepted."""
    kinds: dict[str, Item] = {}
    for x in items:
        for y in x.items if x.label == "()" else [x]:
            kinds[y.label] = merge(kinds[y.label], y) if y.label in kinds else y
    if len(kinds) > MOST_ITEMS:
        names: dict[str, Item] = {}
        for y in kinds.values():
            y.label = y.label.split(".")[0]
            names[y.label] = merge(names[y.label], y) if y.label in names else y
        kinds = names if len(names) <= MOST_ITEMS else {"*": Item("*"), "#": Item("#")}
    group = Item("()", [_maybe(kinds[k]) for k in sorted(kinds)])
    group.repeated = True
    return [group]


def fold(items: list[Item]) -> list[Item]:
    """Runs of alike items become one repeated item, runs of alike sequences a repeated group."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].label == x.label and (x.label != "()" or _key(out[-1]) == _key(x)):
            out[-1] = merge(out[-1], x)
            out[-1].repeated = True
        else:
            out.append(x)
    for period in range(2, MOST_PERIOD + 1):
        if len(out) < 2 * period:
            break
        keys, folded, i = list(map(_key, out)), [], 0
        while i < len(out):
            if keys[i : i + period] == keys[i + period : i + 2 * period]:
                body, j = out[i : i + period], i + period
                while keys[j : j + period] == keys[i : i + period]:
                    body = [merge(x, y) for x, y in zip(body, out[j : j + period], strict=True)]
                    j += period
                group = Item("()", body)
                group.repeated, i = True, j
                folded.append(group)
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def wrapper_of(items: list[Item]) -> list[Item]:
    """A parsed page's own wrapper. Boilerplate is not looked into."""
    out = []
    for x in items:
        y = Item(x.label, wrapper_of(x.items) if x.items and not x.boilerplate else None)
        y.boilerplate = x.boilerplate
        out.append(y)
    return fold(out)


def to_json(items: list[Item]) -> str:
    def plain(x: Item) -> list:
        return [x.label, x.optional + 2 * x.repeated + 4 * x.boilerplate, [plain(y) for y in x.items]]

    return json.dumps([plain(x) for x in items], separators=(",", ":"), ensure_ascii=False)


def from_json(text: str) -> list[Item]:
    def item(x: list) -> Item:
        out = Item(x[0], [item(y) for y in x[2]])
        out.optional, out.repeated, out.boilerplate = bool(x[1] & 1), bool(x[1] & 2), bool(x[1] & 4)
        return out

    return [item(x) for x in json.loads(text)]


class Level:
    """One level of a wrapper as an automaton over labels; it finds for each item of a page the wrapper's item."""

    def __init__(self, items: list[Item]):
        self.at: list[Item] = []
        self.follow: list[set[int]] = []
        self.first, self.last, self.empty = self._sequence(items)
        self.below: dict[int, Level] = {}

    def _sequence(self, items: list[Item]) -> tuple[set[int], set[int], bool]:
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for x in items:
            if x.label == "()":
                f, z, e = self._sequence(x.items)
            else:
                self.at.append(x)
                self.follow.append(set())
                f, z, e = {len(self.at) - 1}, {len(self.at) - 1}, False
            if x.repeated:
                for p in z:
                    self.follow[p] |= f
            for p in last:
                self.follow[p] |= f
            first |= f if empty else set()
            last = z | last if e or x.optional else z
            empty = empty and (e or x.optional)
        return first, last, empty

    def match(self, items: list[Item]) -> list[int | None]:
        """Positions of the items; None for all of them if the level doesn't accept them."""
        steps, now = [], self.first
        for x in items:
            now = {p for p in now if self.at[p].label in (x.label, "*")}
            if not now:
                return [None] * len(items)
            steps.append(now)
            now = set().union(*(self.follow[p] for p in now))
        out: list[int | None] = []
        ends = (steps[-1] & self.last if steps else set()) or None
        if ends is None:
            return [None] * len(items)
        p = min(ends)
        for k in range(len(items) - 1, -1, -1):
            out.append(p)
            if k:
                p = min(q for q in steps[k - 1] if p in self.follow[q])
        return out[::-1]

    def under(self, p: int) -> Level:
        if p not in self.below:
            self.below[p] = Level(self.at[p].items)
        return self.below[p]


@lru_cache(maxsize=2000)
def _level(wrapper: str) -> Level:
    return Level(from_json(wrapper))


def placed_texts(items: list[Item], level: Level, path: str = "") -> Iterator[tuple[int, Item]]:
    """The texts outside boilerplate, each with a number for its place in the wrapper and its words; what the wrapper doesn't accept has no place."""
    for x, p in zip(items, level.match(items), strict=True):
        if p is None or x.boilerplate:
            continue
        if x.label == "#":
            if said := " ".join(x.source.split()):
                yield xxhash.xxh64_intdigest(f"{path}/{p}\0{said}") - (1 << 63), x
        else:
            yield from placed_texts(x.items, level.under(p), f"{path}/{p}")


def _regions(items: list[Item], name: str) -> list[Item]:
    """Outermost elements of that name outside boilerplate."""
    found: list[Item] = []
    for x in items:
        if not x.boilerplate:
            found += [x] if x.label.split(".")[0] == name else _regions(x.items, name)
    return found


def main_text(page: str, wrapper: str | None = None, template: frozenset[int] = frozenset()) -> str:
    """template: numbers of placed_texts of the host's template. Where three quarters of the article would be template, the pages are copies of one another, and nothing is left out."""
    items = parse(page)
    regions = _regions(items, "article") or _regions(items, "main") or items
    dropped = {id(x) for n, x in placed_texts(items, _level(wrapper)) if n in template} if wrapper and template else set()

    def said(dropped: set[int]) -> str:
        pieces: list[str] = []

        def walk(inner: list[Item]) -> None:
            for x in inner:
                if x.label == "#":
                    if id(x) not in dropped:
                        pieces.append(html.unescape(x.source))
                elif not x.boilerplate:
                    line = x.label.split(".")[0] in INLINE
                    if not line:
                        pieces.append(" ")
                    walk(x.items)
                    if not line:
                        pieces.append(" ")

        walk(regions)
        return " ".join("".join(pieces).split())

    whole = said(set())
    return short if dropped and 4 * len(short := said(dropped)) >= len(whole) else whole


def host_column(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


WRAPPERS = "host string, wrapper string"


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), host_column().alias("host"))


def _by_rows(rows: int, each, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                yield pa.RecordBatch.from_arrays(each(whole.slice(i, rows)), names)

    return run


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper of each group of rows (host, salt, wrapper) that follow one another."""
    now: tuple | None = None
    whole: list[Item] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([to_json(whole)])], ["host", "wrapper"])

    for batch in batches:
        for host, salt, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            items = from_json(wrapper)
            if now == (host, salt):
                whole = align(whole, items)
            else:
                if now is not None:
                    yield out()
                now, whole = (host, salt), items
    if now is not None:
        yield out()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) of every host, written. A null url has the host ""."""
    own = lambda b: [b.column(0), pa.array([to_json(wrapper_of(parse(page))) for page in b.column(1).to_pylist()], pa.string())]
    found = _pages(pages).select("host", "html").mapInArrow(_by_rows(256, own, ["host", "wrapper"]), WRAPPERS).groupBy("host", "wrapper").agg(F.count("*").alias("pages"))
    found = written(found, "structures")
    counts = found.groupBy("host").agg(F.sum("pages").alias("pages"))
    left = found.select("host", "wrapper")
    while True:
        sizes = left.groupBy("host").agg(F.count("*").alias("n"))
        if not sizes.where("n > 1").take(1):
            return written(left.join(counts, "host"), "wrappers")
        # As many groups as hold GROUP wrappers each, dealt by a hash of the wrapper; alone, it is its own group.
        dealt = left.join(sizes, "host").select("host", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / GROUP)).alias("salt"), "wrapper")
        left = written(dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_aligned, WRAPPERS).distinct(), "aligned")


def _beside(each: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages with their host's row of a written table; it is broadcast if it is small."""
    sizes = [F.octet_length(c) if t == "string" else 8 * F.size(c) if t.startswith("array") else F.lit(8) for c, t in wrappers.dtypes]
    size = wrappers.agg(F.sum(sum(sizes, F.lit(0)))).first()[0] or 0
    if size <= MOST_BROADCAST_BYTES:
        return each.join(F.broadcast(wrappers), "host", "left")
    salt = F.pmod(F.xxhash64("html"), F.lit(SALTS))
    return each.withColumn("salt", salt).join(wrappers.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["host", "salt"], "left").drop("salt")


def templates(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, template) of hosts that have template text, written: numbers of the texts that all of at least LEAST_PAGES pages have in the same place, if other texts differ."""
    many = wrappers.where(F.col("pages") >= LEAST_PAGES)

    def each(b: pa.RecordBatch) -> list[pa.Array]:
        hosts, numbers = [], []
        for host, page, wrapper in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = {n for n, _ in placed_texts(parse(page), _level(wrapper))} if wrapper else set()
            hosts += [host] * len(own)
            numbers += own
        return [pa.array(hosts, pa.string()), pa.array(numbers, pa.int64())]

    places = _beside(_pages(pages), many.select("host", "wrapper")).where("wrapper is not null").select("host", "html", "wrapper")
    counts = places.mapInArrow(_by_rows(256, each, ["host", "number"]), "host string, number long").groupBy("host", "number").agg(F.count("*").alias("n"))
    everywhere = F.col("n") == F.col("pages")
    found = counts.join(many.select("host", "pages"), "host").groupBy("host").agg(F.collect_list(F.when(everywhere, F.col("number"))).alias("template"), F.count(F.when(~everywhere, 1)).alias("slots"))
    return written(found.where("slots > 0 and size(template) > 0").select("host", "template"), "templates")


def extract(pages: DataFrame, wrappers: DataFrame, template: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null html is empty, and so is the text of a page without any."""

    def each(b: pa.RecordBatch) -> list[pa.Array]:
        texts = [main_text(page, wrapper, frozenset(t or ())) for page, wrapper, t in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
        return [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    hosts = written(wrappers.join(template, "host").select("host", "wrapper", "template"), "hosts")
    return _beside(_pages(pages), hosts).select("page_id", "url", "html", "wrapper", "template").mapInArrow(_by_rows(512, each, ["page_id", "url", "text", "n_chars"]), MAIN_TEXT)


def main_texts(pages: DataFrame) -> DataFrame:
    """Wrappers of all hosts, their template texts, then the main text of every page. Repeated rows keep one row each; an empty table gives none.

    Other columns of pages play no part, whatever they are called. Rows of the same page_id are pages of their own. A host
    of fewer than five pages has no template text.
    """
    wrappers = infer_wrappers(pages)
    return extract(pages, wrappers, templates(pages, wrappers))
