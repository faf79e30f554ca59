"""Column functions and routing on literal rows; expected values derived by hand."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from groundling.functions import text as X
from groundling.sources.routing import route, single_source


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(f(F.col("c"))).collect()]


ROUTES = {
    "1412.6550": ("arxiv", "https://arxiv.org/abs/1412.6550"),
    "2103.13630v2": ("arxiv", "https://arxiv.org/abs/2103.13630"),
    "https://arxiv.org/pdf/2103.13630.pdf": ("arxiv", "https://arxiv.org/abs/2103.13630."),
    "github.com/a": ("github_org", "https://github.com/a"),
    "github.com/a/b/blob/main/x/README.md": ("github_blob", "https://github.com/a/b"),
    "https://github.com/a/b/tree/feature/x": ("github_repo", "https://github.com/a/b"),
    "https://github.com/a/b/pull/7/files": ("github_pr", "https://github.com/a/b/pull/7"),
    "https://github.com/a/b/wiki/Home": ("web", "https://github.com/a/b/wiki/Home"),
    "docs.x.io/llms.txt": ("llms_manifest", "https://docs.x.io/llms.txt"),
    "notes.MD": ("web", "https://notes.MD"),
    "missing.pdf": ("web", "https://missing.pdf"),
    "hello world": ("unknown", "https://hello world"),
    "": ("skip", ""),
    "# c": ("skip", ""),
}


def test_routes(spark):
    df = route(spark.createDataFrame([(k,) for k in [*ROUTES, None]], "raw string"))
    got = {r["raw"]: (r["kind"], r["url"], r["ref"], r["path"], r["pr"]) for r in df.collect()}
    for raw, (kind, url) in ROUTES.items():
        assert got[raw][:2] == (kind, url), raw
    assert got[None][0] == "skip"
    assert got["github.com/a/b/blob/main/x/README.md"][2:4] == ("main", "x/README.md")
    assert got["https://github.com/a/b/tree/feature/x"][2] == "feature"
    assert got["https://github.com/a/b/pull/7/files"][4] == "7"
    local = route(spark.createDataFrame([("a.pdf",)], "raw string"), local_pdf=F.lit(True)).first()
    assert (local["kind"], local["url"]) == ("pdf", "a.pdf")
    assert single_source(arxiv="x", url="y") == ("x", False) and single_source(pdf="p") == ("p", True)


@pytest.mark.parametrize(
    "f, value, expected",
    [
        (X.slugify, "https://a.b/c?d=1", "a.b_c_d_1"),
        (X.slugify, "", ""),
        (lambda c: X.sizeof(c.cast("long")), "1536", "1.5 KB"),
        (lambda c: X.sizeof(c.cast("long")), "12", "12.0 B"),
        (X.norm_text, "Naïve ﬁ ß", "naive fi "),
        (X.normalize_url, "HTTP://A.com/X/?q=1#f", "http://a.com/x/?q=1"),
        (X.strip_html, "a&amp;lt;b", "a<b"),
        (X.strip_html, "x &copy; y", "x &copy; y"),
        (X.strip_html, "<p>a&#8217;b</p><script>x</script>", "a’b"),
        (X.clean_output, "```markdown\n# A\n```", "# A"),
        (X.clean_output, None, ""),
        (X.skill_name, "---\nname: foo \nid: x\n---\nbody name: no\n", "foo"),
        (X.skill_name, "no front\nname: x\n", None),
        (X.parse_json, 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        (X.parse_json, "none", None),
        (X.crawl_prefix, "https://a.b/x/docs/y", "/x/docs"),
        (X.is_docs_url, "docs.a.b/x", True),
        (X.is_docs_url, "https://a.b/x", False),
        (lambda c: X.safe_join("/b", c), "../b2/x", None),
        (lambda c: X.safe_join("/b", c), "a/../c", "/b/c"),
        (lambda c: X.safe_join("/b", c), "/etc", None),
        (X.file_priority, "tests/README.md", 0),
        (X.file_priority, "tests/test_x.py", 8),
        (X.file_priority, "tests/data.csv", 90),
        (X.file_priority, "LICENSE", 50),
        (X.looks_like_html, "  <!DOCTYPE html>", True),
        (X.looks_like_html, "text <b>", False),
        (lambda c: F.size(X.lines(c)), "a\r\nb\x0bc\n", 3),
        (lambda c: F.size(X.lines(c)), "", 0),
        (lambda c: F.size(X.lines(c)), "\n", 1),
    ],
)
def test_scalar(spark, f, value, expected):
    assert one(spark, f, value) == [expected]


def test_fold_and_lines_like_python(spark):
    import random

    rng = random.Random(3)
    values = ["".join(rng.choice("aZé ñ\n\r\x0b\x85ﬁßÅ9_-—") for _ in range(rng.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "c string").select("c", X.norm_text("c").alias("n"), X.lines(F.col("c")).alias("l"))
    for r in df.collect():
        assert r["n"] == unicodedata.normalize("NFKD", r["c"]).encode("ascii", "ignore").decode().lower()
        assert r["l"] == r["c"].splitlines()


def test_fold_of_every_character_without_python(spark):
    marks = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    values = marks + ["".join(marks[k : k + 64]) for k in range(0, len(marks), 64)] + ["ab…½ﬁ𝐀é\u0301 ㎏™x", ""]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "c string").select("c", X.norm_text("c").alias("n"))
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["c"] for r in df.collect() if r["n"] != X.fold(r["c"])] == []


def test_shares_round_like_python(spark):
    values = sorted({(1.0 - u / t) * 100 for t in range(1, 130) for u in range(t + 1)} | {k / 20 for k in range(2001)} | {k / 2000 for k in range(2000)} | {-1.0, 8.35})
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.tenths(F.col("x")).alias("s"))
    assert [(r["x"], r["s"]) for r in df.collect() if r["s"] != f"{r['x']:.1f}"] == []


def test_paper_truncation_looks_for_each_keyword_once(spark):
    df = spark.range(1).selectExpr("cast(id as string) as c")
    plan = df.select(X.paper_truncate(F.col("c"), 2000).alias("cut"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("locate(") == len(X.T.PAPER_KEYWORDS)
    text = "h" * 900 + " Algorithm " + "m" * 900 + " Method " + "t" * 900  # the list's first keyword counts, not the text's
    (got,) = one(spark, lambda c: X.paper_truncate(c, 2000), text)
    at = text.index("Method") - 150
    assert got == text[:800] + f"\n\n[... elided {at - 800} chars; full source on disk ...]\n\n" + text[at : at + 300] + f"\n\n[... elided {len(text) - 600 - at - 300} chars ...]\n\n" + text[-600:]


def test_truncation(spark):
    (t,) = one(spark, lambda c: X.head_tail(c, 100), "x" * 1000)
    assert t.startswith("x" * 55 + "\n") and "905 chars elided" in t and t.endswith("]\n\n" + "x" * 40)
    head = "h" * (100 - len(X.T.FILES_HEADING)) + X.T.FILES_HEADING
    body = "".join(f"### `{k}`\n" + "s" * (n - len(f"### `{k}`\n") - 1) + "\n" for k, n in (("a", 300), ("b", 400), ("c", 100)))
    (p,) = one(spark, lambda c: X.pack_sections(c, 1000), head + body + "### `d`\n" + "z" * 500)
    assert "`a`" in p and "`c`" in p and "`b`" not in p and "> 2 lower-priority" in p
    assert one(spark, lambda c: X.pack_sections(c, 100_000), "short") == ["short"]
