"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of elements and text slots.  The pages of a host are aligned one after the other with the host's
wrapper: sibling streams are matched by element signature, equal siblings fold into a repeated group, what only one
side has becomes optional, and text at the same place becomes a slot, fixed if all pages have the same text there.
Wrappers merge like pages do, so each task folds its own pages first and a host of any size is one small wrapper a task.

What is kept of a page: inside its main element (or article, or what is marked as one) all blocks but those of elements
that say they are something else (menus, forms, adverts, comments ...) and those whose slot has the same text in all of
the host's pages, if enough of these differ; nothing inside an article or a main element is taken for fixed, and there
only names count that can mean nothing else.  What only its class or id marks as something else
is not that if it holds most of the host's varied text, or the page's only main element or article.  In a page without such an element the wrapper tells the main subtree: the smallest that holds most of
the text that varies and is no link.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no main text, wherever they stand.
NEVER = set("script style noscript template svg math iframe object canvas head nav footer aside form button select textarea dialog menu audio video map".split())
RAW = {"script", "style"}
#: One block of text each: a main path ends above them.
BLOCKS = set("p li dt dd td th tr h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = set("address article aside blockquote body details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th".split())
ITEMS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words of class and id values that mark what is no main text, and the article.
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|rail|widget|widgets|footer|foot|header|masthead|topbar|toolbar|"
    r"comment|comments|commentlist|respond|reply|replies|disqus|discussion|share|sharing|social|related|recommended|recommendations|teaser|teasers|newsletter|subscribe|subscription|signup|login|search|searchbox|form|copyright|skip)(?:$|[\s_-])",
    re.I,
)
#: Those that mean the same inside an article, if a class is made of nothing else: other names there are the article's own.
SURE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "sidebar footer masthead topbar toolbar comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations teaser teasers newsletter subscribe subscription signup login searchbox "
    "widget widgets copyright header".split()
)
PLAIN = set("box bar block area list section wrap wrapper container inner outer content item items links buttons button link top bottom left right main form text title slot unit widget post page site inline large small".split())
#: Those of the head of a page or article, whose headings count inside the main text.
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|story|entry|main|content|maincontent)(?:$|[\s_-])", re.I)
#: Bytes of wrappers that are sent to all tasks; different pages a host must have before a text counts as fixed.
BROADCAST_BYTES, FIXED_PAGES = 16 << 20, 8
#: Elements nested deeper are read as part of the one above them, except those that decide what is main text, down to twice that.
_MAX_DEPTH = 150
#: The slot of a page itself.
ROOT = 1


class Node:
    """An element of a page; ``kids`` are elements and strings."""

    __slots__ = ("tag", "sig", "kids", "other", "named", "head", "main", "names")

    def __init__(self, tag: str, attrs: dict):
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".strip()
        role = (attrs.get("role") or "").lower()
        self.tag, self.kids, self.names = tag, [], names
        self.sig = f"{tag}.{'.'.join(sorted((attrs.get('class') or '').lower().split()))}" if attrs.get("class") else tag
        hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        own = tag in NEVER or role in ROLES or hidden
        self.named = not own and tag not in ("html", "body", "main") and tag not in HEADINGS and OTHER.search(names) is not None
        self.other = own or self.named
        self.head = self.named and HEADER.search(names) is not None
        self.main = 3 if tag == "main" or role == "main" else 2 if tag == "article" or (attrs.get("itemprop") or "").lower() == "articlebody" or role == "article" else 1 if tag in ("div", "section", "td") and MAIN.search(names) else 0


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]
        self.tags = [""]  # of open elements; those that share a node have a tag of their own

    def _text(self, s: str) -> None:
        kids = self.stack[-1].kids
        if kids and isinstance(kids[-1], list):
            kids[-1].append(s)
        else:
            kids.append([s])

    def _pop_to(self, at: int) -> None:
        del self.stack[at:], self.tags[at:]

    def handle_starttag(self, tag, attrs):
        stack, tags = self.stack, self.tags
        if tag in CLOSES_P:  # an open paragraph ends here, with whatever inline elements it has
            k = len(stack) - 1
            while k > 0 and (tags[k] in INLINE):
                k -= 1
            if tags[k] == "p" or (tag in HEADINGS and tags[k] in HEADINGS):
                self._pop_to(k)
        if tag in ITEMS:
            for k in range(len(stack) - 1, 0, -1):
                if tags[k] in ITEMS[tag]:
                    self._pop_to(k)
                    break
                if tags[k] in SCOPES[tag]:
                    break
        node, depth = Node(tag, dict(attrs)), len({id(n) for n in stack}) if len(stack) > _MAX_DEPTH else len(stack)
        if tag in VOID:
            stack[-1].kids.append(node)
        elif depth < _MAX_DEPTH or depth < 2 * _MAX_DEPTH and (node.main > 1 or node.other or tag in BLOCKS):
            stack[-1].kids.append(node)
            stack.append(node), tags.append(tag)
        else:
            if tag not in INLINE:  # a block of its own, though it has no node
                stack[-1].kids.append(Node("hr", {}))
            stack.append(stack[-1]), tags.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].kids.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tags[k] == tag:
                if self.stack[k] is self.stack[k - 1] and tag not in INLINE:
                    self.stack[k].kids.append(Node("hr", {}))
                return self._pop_to(k)
            if tag in INLINE and self.tags[k] not in INLINE:
                return

    def handle_data(self, data):
        if self.tags[-1] not in RAW and self.stack[-1].tag not in RAW:
            self._text(data)


def parse(page: str) -> Node:
    p = _Tree()
    try:
        p.feed(page)
        p.close()
    except (AssertionError, ValueError):  # a broken declaration: the rest is read without markup
        p._text(html.unescape(re.sub(r"<[^>]*>?", " ", p.rawdata)))
    for node in _all(p.root):
        node.kids = ["".join(k) if isinstance(k, list) else k for k in node.kids]
    _own_names(p.root)
    return p.root


def _all(node: Node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in n.kids if isinstance(k, Node)]


def tidy(s: str) -> str:
    return " ".join(s.split())


# ---------------------------------------------------------------- wrappers


class Wrapper:
    """A node of a union-free expression: its signature, in how many pages, whether repeated, and its parts in order.

    ``fixed``: the texts that all pages have in this slot, as slot hash and length; ``always``: whether all pages that
    have the parent have this; ``chars``, ``links``: characters of all text and of link text, summed over pages;
    ``seen``: at the root, the least hashes of different pages, ``FIXED_PAGES`` of them at most.
    """

    __slots__ = ("sig", "pages", "most", "fixed", "always", "chars", "links", "kids", "other", "named", "seen")

    def __init__(self, sig: str, other: bool = False, named: bool = False):
        self.sig, self.pages, self.most, self.fixed, self.always, self.chars, self.links, self.kids, self.other, self.named, self.seen = sig, 1, 1, {}, True, 0, 0, [], other, named, frozenset()

    def __getstate__(self):
        return tuple(getattr(self, k) for k in self.__slots__)

    def __setstate__(self, state):
        for k, v in zip(self.__slots__, state):
            setattr(self, k, v)


def _hash(text: str, at: int) -> int:
    """Of a text in the slot ``at``, and of the slot of a part with that signature."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), at) >> 1


def page_wrapper(root: Node) -> Wrapper:
    """A page's own wrapper, which knows the page: copies with the same texts in the same slots are one."""
    w = wrapper_of(root, ROOT)
    w.seen = frozenset([_hash(repr(_shape(w)), 0)])
    return w


def _shape(w: Wrapper) -> tuple:
    return w.sig, w.chars, sorted(w.fixed), [_shape(k) for k in w.kids]


def wrapper_of(node: Node, at: int) -> Wrapper:
    """The wrapper of one element in the slot ``at``; inline elements are part of their block's text slot."""
    w = Wrapper(node.sig, node.other, node.named)
    if node.other and not node.named:
        return w
    parts, text = [], []
    _flow(node, parts, text, w, False)
    own = tidy("".join(text))
    w.chars = len(own)
    if own:
        w.fixed = {_hash(own, at): len(own)}
    folded: dict[str, Wrapper] = {}
    for kid in parts:
        own = wrapper_of(kid, _hash(kid.sig, at))
        if own.sig in folded:  # equal siblings: a repeated group
            merge(folded[own.sig], own, True)
        else:
            folded[own.sig] = own
            w.kids.append(own)
    return w


def _flow(node: Node, parts: list, text: list, w: Wrapper, link: bool) -> None:
    for k in node.kids:
        if isinstance(k, str):
            text.append(k)
            if link:
                w.links += len(k.strip())
        elif k.tag in INLINE and not k.other:
            _flow(k, parts, text, w, link or k.tag == "a")
        else:
            parts.append(k)


def merge(a: Wrapper, b: Wrapper, repeat: bool = False) -> None:
    """Align ``b`` with ``a``, which becomes the wrapper of both: of two pages, or of two siblings of one page."""
    if repeat:
        a.most += b.most
        a.fixed = a.fixed | b.fixed
    else:
        a.pages, a.most = a.pages + b.pages, max(a.most, b.most)
        a.fixed = {h: n for h, n in a.fixed.items() if h in b.fixed}
        a.always = a.always and b.always
        a.seen = frozenset(sorted(a.seen | b.seen)[:FIXED_PAGES])
        both = {k.sig for k in a.kids} & {k.sig for k in b.kids}
        for k in a.kids + b.kids:
            k.always = k.always and k.sig in both
    a.other, a.named = a.other and b.other, a.named or b.named
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    at = {k.sig: i for i, k in enumerate(a.kids)}
    out, done, pending = [], 0, []
    for kid in b.kids:
        i = at.get(kid.sig)
        if i is None:
            pending.append(kid)  # optional: only here so far
            continue
        merge(a.kids[i], kid, repeat)
        if i >= done:
            out += a.kids[done:i] + pending + [a.kids[i]]
            pending, done = [], i + 1
    a.kids = out + pending + a.kids[done:]


def _varied(w: Wrapper, known: bool, named: bool = False) -> float:
    """Characters that are no link and not the same on all pages; ``known``: whether fixed texts can be told here.

    ``named``: also those of elements that only a name marks as something else.
    """
    if w.other and not (named and w.named):
        return 0
    same = w.pages * sum(w.fixed.values()) if known else 0
    return max(0, w.chars - same - 2 * w.links) + sum(_varied(k, known and k.always, named) for k in w.kids)


def _chars(w: Wrapper) -> int:
    return 0 if w.other else w.chars + sum(map(_chars, w.kids))


def _known(w: Wrapper) -> bool:
    """Whether a host has enough different pages to tell what is fixed."""
    return len(w.seen) >= FIXED_PAGES


def clear_names(w: Wrapper) -> list[int]:
    """Slots of the elements whose name does not count, as they hold most of the varied text; they are cleared here."""
    known = _known(w)
    total, at, out = _varied(w, known, True), ROOT, []
    while total:
        most, best = max(((_varied(k, known and k.always, True), k) for k in w.kids), key=lambda x: (x[0], x[1].sig), default=(0, None))
        if best is None or 2 * most <= total:
            break
        w, known, at = best, known and best.always, _hash(best.sig, at)
        if w.named:
            w.other = w.named = False
            out.append(at)
    return out


def main_path(w: Wrapper) -> tuple[str, ...]:
    """Signatures from the root to the smallest subtree with nine tenths of the varied text."""
    known, path = _known(w), []
    total = _varied(w, known)
    while total:
        most, best = max(((_varied(k, known and k.always), k) for k in w.kids if not k.other), key=lambda x: (x[0], x[1].sig), default=(0, None))
        if best is None or most < 0.9 * total or best.sig.partition(".")[0] in BLOCKS:
            break
        path.append(best.sig)
        w, known = best, known and best.always
    return tuple(path)


def fixed_texts(w: Wrapper) -> set[int]:
    """Slot hashes of the texts that all pages have in one slot; none where pages are mostly copies of each other."""
    out, stack = set(), [w]
    if not _known(w) or 2 * _varied(w, True) < _chars(w):
        return out
    while stack:
        x = stack.pop()
        out |= x.fixed.keys()
        stack += [k for k in x.kids if k.always and not k.other]
    return out


# ---------------------------------------------------------------- text of a page


def _blocks(node: Node, at: int, fixed: frozenset, out: list[str], heads_only: bool = False) -> None:
    """Blocks in page order without the fixed ones.  A header inside the main text gives its headings only."""
    held: list[str] = []
    slots: set[int] = set()  # 0: inside an article or main element, where nothing is fixed

    def flush():
        if (t := tidy("".join(held))) and not (fixed and len(slots) == 1 and (slot := next(iter(slots))) and _hash(t, slot) in fixed):
            out.append(t)
        held.clear()
        slots.clear()

    def walk(n: Node, heads: bool, at: int) -> None:
        for k in n.kids:
            if isinstance(k, str):
                if not heads:
                    held.append(k)
                    if not k.isspace():
                        slots.add(at)
            elif k.head and k.other and k.tag not in INLINE:
                flush()
                walk(k, True, 0)
                flush()
            elif k.other:
                if k.tag not in INLINE:
                    flush()
            elif k.tag in ("br", "wbr", "img"):
                held.append(" " if k.tag == "br" else "")
            elif k.tag in INLINE:
                walk(k, heads, at)
            else:
                slot = 0 if k.main > 1 or not at else _hash(k.sig, at)
                if k.tag in ("td", "th"):
                    held.append(" ")
                    walk(k, heads, slot)
                    held.append(" ")
                else:
                    flush()
                    walk(k, (heads or k.tag == "header") and k.tag not in HEADINGS, slot)
                    flush()

    walk(node, heads_only, 0 if node.main > 1 else at)
    flush()


def _mains(root: Node) -> list[tuple[Node, int]]:
    """The outermost of the surest kind of main elements, and their slots."""
    found: dict[int, list[tuple[Node, int]]] = {}
    stack: list[tuple[Node, int, frozenset]] = [(root, ROOT, frozenset())]
    while stack:
        n, at, inside = stack.pop()
        if n.other:
            continue
        if n.main and n.main not in inside:
            found.setdefault(n.main, []).append((n, at))
            inside = inside | {n.main}
        if n.main > 1:
            at = 0
        stack += [(k, at if k.tag in INLINE or not at else _hash(k.sig, at), inside) for k in reversed(n.kids) if isinstance(k, Node)]
    for kind in (3, 2, 1):
        if kind in found and (kind > 1 or len(found[kind]) == 1):
            return found[kind]
    return []


def _sure(names: str) -> bool:
    """Whether one of the classes is made of sure words, and plain ones beside them, only."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if any(w in SURE for w in words) and all(w in SURE or w in PLAIN or w.isdigit() for w in words):
            return True
    return False


def _own_names(root: Node) -> None:
    """Inside an article or main element a name that may mean something else marks nothing."""
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        if inside and n.named and not _sure(n.names):
            n.named = n.other = n.head = False
        inside = inside or n.main > 1
        stack += [(k, inside) for k in n.kids if isinstance(k, Node)]


def _own_chars(node: Node) -> int:
    """Characters of text that is no link, in what is no other element."""
    return sum(len(tidy(k)) if isinstance(k, str) else 0 if k.other or k.tag == "a" else _own_chars(k) for k in node.kids)


def _clear(root: Node, clear: frozenset) -> None:
    """Names that do not count: of the slots ``clear``, and of what holds the page's only main elements or articles.

    In a page whose main elements hold a tenth of their text outside such names, the names count.
    """
    mains = [n for n, _ in _mains(root) if n.main > 1] if clear else []
    if clear and 10 * sum(map(_own_chars, mains)) <= sum(_own_text(k) for n in mains for k in _reachable(n)):
        stack = [(root, ROOT)]
        while stack:
            n, at = stack.pop()
            if n.named and at in clear:
                n.named = n.other = False
            stack += [(k, at if k.tag in INLINE and not k.other else _hash(k.sig, at)) for k in n.kids if isinstance(k, Node)]
    while not any(n.main > 1 for n, _ in _mains(root)):
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.named:
                if any(k.main > 1 for k in _reachable(n)):
                    found.append(n)
            elif not n.other:
                stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
        best = max(found, key=lambda n: sum(map(_own_text, _reachable(n))), default=None)
        if best is None or sum(map(_own_text, _reachable(best))) < _own_chars(root):
            return
        for n in found:
            if n is best or n.main > 1 and best.main > 1 and n.sig == best.sig:
                n.named = n.other = False


def _own_text(node: Node) -> int:
    return 0 if node.tag == "a" else sum(len(tidy(k)) for k in node.kids if isinstance(k, str))


def _reachable(node: Node):
    """An element and all below it but what is another element by more than its name."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in n.kids if isinstance(k, Node) and (k.named or not k.other)]


def main_text(root: Node, wrapper: tuple | None = None) -> str:
    """Blocks of the main text joined by \\n; ``wrapper`` is (main path, fixed texts, slots of names that do not count)."""
    out: list[str] = []
    path, fixed, clear = wrapper or ((), frozenset(), frozenset())
    _clear(root, clear)
    nodes = _mains(root)
    if nodes:
        path = ()
    else:
        nodes = [(root, ROOT)]
    for sig in path:
        deeper = [(k, _hash(sig, at)) for n, at in nodes for k in _parts(n) if k.sig == sig and not k.other]
        if not deeper:
            break
        nodes = deeper
    for n, at in nodes:
        if not n.other:
            _blocks(n, at, fixed, out)
    return "\n".join(out)


def _parts(node: Node) -> list[Node]:
    out: list[Node] = []
    for k in node.kids:
        if isinstance(k, Node):
            out += _parts(k) if k.tag in INLINE and not k.other else [k]
    return out


# ---------------------------------------------------------------- over a table


def host_of(url: str) -> Column:
    """Lower-case host of a url; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _pack(w: Wrapper) -> bytes:
    return zlib.compress(pickle.dumps(w, protocol=5))


def _own_wrappers(batches):
    """A wrapper a host of this task's pages."""
    held: dict[str, Wrapper] = {}
    size = 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([_pack(w) for w in held.values()], pa.binary())], ["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            own = page_wrapper(parse(page or ""))
            if host in held:
                merge(held[host], own)
            else:
                held[host] = own
        if len(held) > 5000:  # bounded memory: what is there goes on, more follows
            yield rows()
            held = {}
    if held:
        yield rows()


def _merged(key, batches):
    """One wrapper of all of a group's, taken in the order of their bytes."""
    blobs = sorted(x.as_py() for b in batches for x in b.column("wrapper"))
    w = pickle.loads(zlib.decompress(blobs[0]))
    for x in blobs[1:]:
        merge(w, pickle.loads(zlib.decompress(x)))
    yield w


def infer_wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(host, path, fixed, clear): what the wrapper of each host says, from all its pages."""
    partial = pages.select(host_of("url").alias("host"), "html").mapInArrow(_own_wrappers, "host string, wrapper binary")

    def some(key, batches):
        for w in _merged(key, batches):
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([_pack(w)], pa.binary())], ["host", "wrapper"])

    def last(key, batches):
        for w in _merged(key, batches):
            clear = clear_names(w)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([list(main_path(w))], pa.list_(pa.string())), pa.array([sorted(fixed_texts(w))], pa.list_(pa.int64())), pa.array([clear], pa.list_(pa.int64()))], ["host", "path", "fixed", "clear"])

    first = _grouped(partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))), ["host", "salt"], some, "host string, wrapper binary")
    return _grouped(first, ["host"], last, "host string, path array<string>, fixed array<long>, clear array<long>")


def _grouped(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(f(key, table.to_batches())))

    return df.groupBy(*keys).applyInArrow(run, schema)


def extract_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Null html counts as empty; a page without main text has an empty one.  Pages whose url is null or has no host share
    one wrapper.  Rows that repeat stay; an empty table gives no rows; other columns, whatever their names, are ignored.
    Wrappers go to all tasks if their checked size is at most ``broadcast_bytes``, else they are joined by host.
    """
    spark = small_batches(pages).sparkSession
    wrappers = cut(infer_wrappers(pages), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("host") + 8 * F.size("fixed") + 8 * F.size("clear") + F.length(F.concat_ws(" ", "path")) + 64), F.lit(0))).first()[0]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host"))
    shared = None
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r["host"]: (tuple(r["path"]), frozenset(r["fixed"]), frozenset(r["clear"])) for r in wrappers.toLocalIterator()})
    else:
        rows = rows.join(wrappers, "host", "left")

    def run(batches):
        for batch in batches:
            if shared is not None:
                own = [shared.value.get(h) for h in batch.column("host").to_pylist()]
            else:
                own = [None if p is None else (tuple(p), frozenset(f), frozenset(c)) for p, f, c in zip(*(batch.column(k).to_pylist() for k in ("path", "fixed", "clear")))]
            texts = [main_text(parse(h or ""), w) for h, w in zip(batch.column("html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
