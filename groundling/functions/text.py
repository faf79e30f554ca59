"""Scalar functions as Column expressions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import functools
import posixpath
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables as T
from .batches import give_back


def lit(s: str) -> Column:
    return F.lit(s)


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def escaped(c: Column) -> Column:
    """A value as a regular expression that matches it; white space stays as it is."""
    return F.regexp_replace(c, r"([^\w\s])", r"\\$1")


#: What ends a line, and the whole of it at the end of a text.
_EOL = "(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])"


def lines(c: Column) -> Column:
    """The lines of a text; a text that ends a line has no empty line after it, an empty text has none at all."""
    body = F.regexp_replace(c, _EOL + r"\z", "")
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.split(body, _EOL, -1))


# ---------------------------------------------------------------- names, sizes, urls


def slugify(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(strip(c), "https?://", ""), "[^a-zA-Z0-9._-]+", "_")
    return F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, 80)


def short_hash(c: Column, n: int = 8) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, n)


def sizeof(c: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1; one decimal, exact halves to even as binary rounding gives."""
    out = F.lit(None).cast("string")
    x = c.cast("double")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        y = x / float(1024**k)
        shown = F.concat(F.format_string("%.1f", F.bround(y, 1)), F.lit(f" {unit}"))
        out = shown if k == 4 else F.when(F.abs(y) < 1024, shown).otherwise(out)
    return F.when(c.isNotNull(), out)


def tenths(c: Column) -> Column:
    """A share such as a percentage with one decimal, rounded by its exact binary value, halves to even; ``format_string`` takes halves up.

    The upper bits and the rest are compared with the half apart, so that no step rounds.
    """
    x = F.abs(c.cast("double"))
    high, k = F.floor(x * 2**20) / 2**20, F.floor(x * 10)
    beyond = (high * 10 - (k + F.lit(0.5))) + (x - high) * 10
    n = k + F.when((beyond > 0) | ((beyond == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def normalize_url(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", ""))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def with_scheme(c: Column) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))


def is_docs_url(c: Column) -> Column:
    """Whether a url is read by crawling."""
    u = with_scheme(c)
    path, host = F.lower(url_path(u)), url_host(u)
    return functools.reduce(Column.__or__, [path.contains(t) for t in T.DOCS_PATHS] + [host.contains(t) for t in T.DOCS_HOSTS])


def crawl_prefix(c: Column) -> Column:
    """The path up to the end of the first of the known prefixes (in their order) that it holds; else empty."""
    path = F.regexp_replace(url_path(with_scheme(c)), "/+$", "")
    found = [F.when(path.contains(p), F.substring_index(path, p, 1)) for p in T.CRAWL_PREFIXES]
    return F.coalesce(*[F.concat(f, F.lit(p)) for f, p in zip(found, T.CRAWL_PREFIXES)], F.lit(""))


def may_follow(link: Column, root_host: Column, prefix: Column) -> Column:
    """Whether a crawl takes a link: same host, no excluded ending, below the prefix."""
    ends = functools.reduce(Column.__or__, [F.lower(link).endswith(e) for e in T.NO_FOLLOW])
    return (url_host(link) == root_host) & ~ends & url_path(link).startswith(prefix)


@F.pandas_udf(StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link resolved against its page, by the general rules."""
    from urllib.parse import urljoin

    def one(b, k):
        try:
            return urljoin(b or "", k) if k is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, k) for b, k in zip(base, link)], dtype=object)


def safe_join(base: str, c: Column) -> Column:
    """Absolute path of ``c`` below ``base``; null if it leaves it. A fold over the segments: a path may not climb above."""
    base = posixpath.normpath(base)
    rel = F.replace(c, F.lit("\\"), F.lit("/"))
    absolute = F.when(rel.startswith("/"), rel).otherwise(F.concat(F.lit(base + "/"), rel))
    parts = F.aggregate(
        F.split(absolute, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    full = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when((full == base) | full.startswith(base.rstrip("/") + "/"), full)


# ---------------------------------------------------------------- folding


def fold(s: str | None) -> str:
    """NFKD, then ASCII only, then lower case."""
    if not s:
        return ""
    return (s if s.isascii() else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()).lower()


@functools.cache
def _folded() -> tuple[str, str, str, str]:
    """What folding makes of characters beyond ASCII: those of one ASCII character, these; those of more, as a map for ``str_to_map``, and as a class."""
    one, more = {}, {}
    for x in range(0x80, 0x110000):
        if not 0xD800 <= x < 0xE000 and (t := fold(chr(x))):
            (one if len(t) == 1 else more)[chr(x)] = t
    runs: list[list[int]] = []
    for x in map(ord, more):
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "".join(one), "".join(one.values()), "\2".join(f"{k}\1{t}" for k, t in more.items()), "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


def norm_text(c: Column | str) -> Column:
    """``fold`` as an expression: no character's folding depends on those beside it, so a table of characters does it; null gives an empty text."""
    c = F.col(c) if isinstance(c, str) else c
    one, to, more, several = _folded()
    parts = F.regexp_extract_all(c, F.lit(f"[^{several}]+|[{several}]"), F.lit(0))
    spelled = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(F.str_to_map(F.lit(more), F.lit("\2"), F.lit("\1")), p), p)), "")
    other = F.regexp_replace(F.translate(F.when(F.regexp_replace(c, r"[\x00-\x7F]+", "").rlike(f"[{several}]"), spelled).otherwise(c), one, to), r"[^\x00-\x7F]+", "")
    return F.when(c.isNull(), "").when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.lower(other))


@F.pandas_udf(StringType())
def norm_text_arrow(s: pd.Series) -> pd.Series:
    """``fold`` by Arrow batches, for SQL users, who call it by name."""
    return s.map(fold, na_action=None)


# ---------------------------------------------------------------- html


def looks_like_html(c: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(c, r"(?U)^\s+", ""), 1, 200))
    starts = head.startswith("<!doctype") | head.startswith("<html") | head.startswith("<?xml")
    return F.coalesce(starts | (F.regexp_count(c, F.lit(T.STRUCTURAL_TAG)) >= 8), F.lit(False))


def _numeric_entities(c: Column) -> Column:
    """Decimal character references as their characters (none beyond Unicode), in one pass: what is between them and they take turns."""
    ref = r"&#(\d+);"
    code = lambda d: F.try_to_number(F.right(d, F.lit(9)), F.lit("999999999")).cast("int")
    known = lambda d: (F.length(F.regexp_replace(d, "^0+", "")) <= 7) & (code(d) < 0x110000)
    char = lambda d: F.when(known(d), F.decode(F.unhex(F.lpad(F.hex(code(d)), 8, "0")), "UTF-32")).otherwise("")
    between = F.split(c, r"&#\d+;", -1)
    codes = F.regexp_extract_all(c, F.lit(ref), F.lit(1))
    joined = F.zip_with(between, codes, lambda t, d: F.concat(t, F.coalesce(F.when(d.isNotNull(), char(d)), F.lit(""))))
    return F.when(c.contains("&#"), F.array_join(joined, "")).otherwise(c)


def strip_html(c: Column, numeric: bool = True) -> Column:
    """Text without tags and noise, named entities decoded in order; ``numeric``: numeric ones too."""
    for tag in ("script", "style", "svg", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    c = F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", ""), "<[^>]+>", "")
    for name, char in T.NAMED_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    if numeric:
        c = _numeric_entities(c)
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def html_to_markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Markdown of a page without scripts, navigation and marked side matter: headings, lists, links, code and paragraphs.

    A deterministic form of our own; what third-party converters print cannot be reproduced.
    """
    from .markdown import convert

    for s in batches:
        yield s.map(lambda t: convert(t or ""), na_action=None)
    give_back()


def extraction_sparse(c: Column, threshold: int = 1500) -> Column:
    for pattern in (r"(?m)^#{1,6}\s+.*$", r"(?m)^```.*$", r"_\([^)]+\)_", r"(?U)\s+"):
        c = F.regexp_replace(c, pattern, "")
    return F.coalesce(F.length(c) < threshold, F.lit(True))


# ---------------------------------------------------------------- generated text


def clean_output(c: Column) -> Column:
    """Generated text without the fence around it."""
    t = strip(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"(?U)^```(?:markdown|md|yaml|)\s*", "")
    return F.regexp_replace(t, r"(?U)\s*```\z", "")


def skill_name(c: Column) -> Column:
    """``name:`` of leading front matter; null if there is none."""
    front = F.regexp_extract(c, r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*\r?\n", 1)
    return F.nullif(strip(F.regexp_extract(front, r"(?m)^name:\s*(.+)$", 1)), F.lit(""))


def prompt_family(kind: Column) -> Column:
    return F.when(kind.isin(*T.PAPER_KINDS), "paper").when(kind.isin("github_repo", "github_blob", "github_pr"), "repo").otherwise("web")


def parse_json(c: Column) -> Column:
    """Generated JSON as text of the first that parses: all of it, the first object of two levels, the widest object; else null."""
    t = strip(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^```(?:json)?\s*\n?", ""), r"\n?```\s*\z", ""))
    inner = F.regexp_extract(t, r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0)
    first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    widest = F.when((first > 0) & (last > first), F.substring(t, first, last - first + 1))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (t, F.nullif(inner, F.lit("")), widest)])


# ---------------------------------------------------------------- files


def file_priority(path: Column) -> Column:
    out = F.lit(T.OTHER_PRIORITY)
    for pattern, score in reversed(T.FILE_PRIORITY):
        out = F.when(path.rlike("(?i)" + pattern), F.lit(score)).otherwise(out)
    return out


def suffix(path: Column) -> Column:
    """Extension in lower case with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, T.SKIP_DIRS)))


def is_binary_name(path: Column) -> Column:
    return suffix(path).isin(*T.BINARY_EXTS)


def is_binary_content(content: Column) -> Column:
    """Of a BINARY column: a zero byte among the first 8192."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def decode_utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def skipped_by_guard(path: Column) -> Column:
    return functools.reduce(Column.__or__, [path.rlike(p) for p in T.SKIP_FILES])


# ---------------------------------------------------------------- truncation


def head_tail(c: Column, budget: int) -> Column:
    h, t = int(budget * 0.55), int(budget * 0.40)
    gone = F.format_number(F.length(c) - (h + t), 0)
    cut = F.concat(F.substring(c, 1, h), F.lit("\n\n[... "), gone, F.lit(" chars elided; full source on disk ...]\n\n"), F.right(c, F.lit(t)))
    return F.when(F.length(c) <= budget, c).otherwise(cut)


def bound(value: Column, f) -> Column:
    """``f`` of a value that is found once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def paper_truncate(c: Column, budget: int) -> Column:
    """Head, tail, and a middle around the first known keyword (by the list's order) between them, else the midpoint."""
    h, t = int(budget * 0.40), int(budget * 0.30)
    mid = budget - h - t - 300
    places = F.array(*[F.when(c.contains(k), F.locate(k, c, h + 1) - 1) for k in T.PAPER_KEYWORDS])  # most texts have none of a keyword
    shown = lambda x: F.format_number(x, 0)

    def cut(n, start, end):
        return F.concat(
            F.substring(c, 1, h), F.lit("\n\n[... elided "), shown(start - h), F.lit(" chars; full source on disk ...]\n\n"), F.when(end > start, F.substring(c, start + 1, end - start)).otherwise(""),
            F.lit("\n\n[... elided "), shown(n - t - end), F.lit(" chars ...]\n\n"), F.right(c, F.lit(t)),
        )

    def around(n):
        at = F.coalesce(F.get(F.filter(places, lambda p: (p >= 0) & (p < n - t)), F.lit(0)), F.floor(n / 2).cast("int"))
        return bound(F.greatest(F.lit(h), at - mid // 2), lambda start: bound(F.least(n - t, start + mid), lambda end: cut(n, start, end)))

    return F.when(F.length(c) <= budget, c).otherwise(bound(F.length(c), around))


def pack_sections(c: Column, budget: int) -> Column:
    """Greedy packing of a repository bundle: every file section that still fits stays, others are counted and left out.

    A bundle without the files heading is cut like any text.
    """
    at = F.locate(T.FILES_HEADING, c)
    size = len(T.FILES_HEADING)
    header = F.substring(c, F.lit(1), at + size - 1)
    sections = F.split(F.substring(c, at + size, F.length(c)), "(?m)(?=^### `)", -1)
    start = F.struct(F.length(header).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(0).alias("dropped"))

    def step(acc, s):
        fits = acc["used"] + F.length(s) <= budget - 500
        return F.struct(
            F.when(fits, acc["used"] + F.length(s)).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["dropped"]).otherwise(acc["dropped"] + 1).alias("dropped"),
        )

    done = F.aggregate(sections, start, step)
    note = F.concat(F.lit("\n\n> "), done["dropped"].cast("string"), F.lit(" lower-priority file section(s) elided to fit LLM input budget; full source on disk under .sources/.\n\n"))
    return F.when(F.length(c) <= budget, c).when(at == 0, head_tail(c, budget)).otherwise(F.concat(header, F.array_join(done["kept"], ""), note))


def truncate_for_model(kind: Column, c: Column, budget: int) -> Column:
    return F.when(kind.isin(*T.REPO_KINDS), pack_sections(c, budget)).when(kind.isin(*T.PAPER_KINDS), paper_truncate(c, budget)).otherwise(head_tail(c, budget))
