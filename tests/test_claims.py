"""Lines, claims, verification and extraction on hand-made documents."""

import pytest
from pyspark.sql import functions as F

from groundling.functions.lineage import cut
from groundling.operators import bundle as B
from groundling.operators import claims as C
from groundling.operators import loop as L
from groundling.operators import report as R
from groundling.operators import verbatim as E
from groundling.operators import verify as V
from groundling.options import Options
from groundling.sources import readers as S


def claims_of(spark, text):
    lines = C.skill_lines(spark.createDataFrame([(1, text)], "source_id long, skill_text string"), "source_id")
    return [(r["ctype"], r["value"]) for r in C.claims(lines, "source_id").orderBy("line_no", "claim_seq").collect()]


def test_claim_types(spark):
    got = claims_of(spark, "The `settlePayment()` call takes 12ms, see https://x.org/api.")
    assert got == [("code", "settlePayment()"), ("url", "https://x.org/api"), ("path", "x.org/api."), ("number", "12ms"), ("identifier", "settlePayment"), ("identifier", "x.org")]
    assert claims_of(spark, "Accuracy is 99.8.") == []
    assert claims_of(spark, "Over 3,000 runs") == [("number", "000")]
    assert claims_of(spark, "call (624) 555-2408") == [("number", "624"), ("number", "555"), ("number", "2408")]
    assert claims_of(spark, "# Uses REST and fooBar 17") == [("number", "17")]
    assert claims_of(spark, "uses REST, `true` and FLOPS or FLOPs") == [("identifier", "REST"), ("identifier", "FLOPS")]
    assert claims_of(spark, "") == []


@pytest.mark.parametrize(
    "ctype, claim, source, found",
    [
        ("number", "99.8", "it is 99.8.", False),
        ("number", "20", "10-20", False),
        ("number", "3", "13", False),
        ("number", "50ms", "50 ms", True),
        ("number", "50", "50ms", True),
        ("quoted", "verify", "verification", False),
        ("quoted", "exact  scheme", "exact\nscheme", True),
        ("code", r"a\eb.c(", r"x a\eb.c( y", True),
        ("code", "a.c", "abc", False),
        ("url", "https://x.org/a.", "see https://x.org/abc", True),
        ("code", "", "anything", True),
    ],
)
def test_matching(spark, ctype, claim, source, found):
    df = spark.createDataFrame([(claim, ctype, source)], "v string, t string, s string")
    assert df.select(V.in_source(F.col("v"), F.col("t"), F.col("s"))).first()[0] is found


DOC = "---\nname: x\ndescription: uses REST\n---\n# T\n## One\n`alpha` and `beta`\n### Sub\n```\n'gamma ray' 42kg\n```\n## Two\nplain\n"


def test_document(spark):
    skills = spark.createDataFrame([(1, DOC), (2, ""), (3, None)], "source_id long, skill_text string")
    lines = C.skill_lines(skills, "source_id")
    state = {r["line_no"]: (r["section"], r["in_yaml"], r["is_skipped"]) for r in lines.where("source_id = 1").collect()}
    assert state[1][2] and state[2][2] and not state[3][2] and state[3][1] and state[4][2] and state[9][2] and not state[10][2]
    assert state[8][0] == "One" and state[5][0] == "(top)" and state[13][0] == "Two"
    sources = spark.createDataFrame([(1, "Alpha, rest; gamma\n ray of 42 kg")], "source_id long, text string")
    verified = V.verify_claims(C.claims(lines, "source_id"), V.fold_sources(sources), "source_id")
    bad = {r["value"] for r in verified.where("not verified").collect()}
    assert bad == {"beta"}
    sections = V.section_stats(lines, verified, "source_id")
    one = sections.where("section = 'One'").first()
    assert (one["claims_total"], one["claims_unverified"], one["flagged_lines"]) == (4, 1, 1) and one["pct_verified"] == 75.0
    two = sections.where("section = 'Two'").first()
    assert two["claims_total"] == 0 and two["pct_verified"] == 100.0
    s = V.summaries(lines, sections, "source_id").where("source_id = 1").first()
    assert (s["total_lines_checked"], s["claims_unverified"], s["lines_flagged"]) == (13, 1, 1)
    checks = V.line_checks(lines, verified, "source_id")
    assert "`beta`  <!-- ⚠ UNVERIFIED: beta -->" in R.annotate(lines, checks, "source_id").where("source_id = 1").first()["annotated"]
    assert "- Line 7: `alpha` and `beta`\n  Unverified claims: code:beta" == V.feedback_block(checks, "source_id").first()["feedback"]
    report = R.verification_report(V.summaries(lines, sections, "source_id"), checks, "source_id").where("source_id = 1").first()["report"]
    assert "| One | 4 | 1 | 75.0% | 1/" in report and "| Two |" not in report


def test_dangerous_and_rounds(spark):
    rows = [("Usage", 3, 1), ("Overview", 10, 1), ("Notes", 10, 2), ("Types", 2, 1)]
    df = spark.createDataFrame([(s, t, u, (1 - u / t) * 100) for s, t, u in rows], "section string, claims_total long, claims_unverified long, pct_verified double")
    assert {r["section"] for r in V.dangerous_sections(df).collect()} == {"Usage", "Notes"}
    rounds = spark.createDataFrame([(1, 0, 90.0), (1, 1, 90.0), (1, 2, 80.0), (2, 0, 0.0), (2, 1, 0.0)], "source_id long, round int, pct_verified double")
    assert {r["source_id"]: (r["best_round"], r["pct_verified"]) for r in V.best_round(rounds, "source_id").collect()} == {1: (0, 90.0), 2: (1, 0.0)}
    keys = R.skill_keys(spark.createDataFrame([(1, "n", "u1"), (2, "n", "u2"), (3, "n", "u1")], "source_id long, name string, url string"))
    got = {r["source_id"]: r["skill_key"] for r in keys.collect()}
    assert got[1] == got[3] == "n" and got[2].startswith("n__") and len(got[2]) == 9


def test_loop(spark):
    bundles = spark.createDataFrame([(1, "web", "u", "alpha beta 42"), (2, "web", "v", "")], "source_id long, kind string, url string, text string")

    def model(system, prompt):
        if system == "repair":
            return '## S\n"alpha beta" is long enough to be kept here'
        return '## S\n"made up thing" is not in the source at all' if "alpha" in prompt else ""

    skills, rounds = L.agentic_loop(bundles, model, cut, Options(agentic_retries=1))
    got = {r["source_id"]: (r["round"], r["pct_verified"]) for r in skills.collect()}
    assert got == {1: (1, 100.0)} and rounds.count() == 2
    calls = []
    with pytest.raises(ValueError):
        L.with_retries(lambda s, p: calls.append(1) or (_ for _ in ()).throw(ValueError("x")))("", "")
    assert len(calls) == 3 and L.with_retries(lambda s, p: (_ for _ in ()).throw(ValueError("429")))("", "") == ""


def test_signatures(spark):
    cases = {
        "a/1.py": ('@d\ndef f(a,\n      b):\n    """doc\n    more\n    """\n    return 1\nx = 1', '@d\ndef f(a,\n      b):\n    """doc\n    more\n    """\n'),
        "a/2.py": ("def f(): return 1\ny = 2", "def f(): return 1\ny = 2\n"),
        "a/3.py": ("class A:\n    '''one'''\n    def g(self):\n        \"\"\"\n        never shut", "class A:\n    '''one'''\n\n    def g(self):\n        \"\"\"\n        never shut\n"),
        "a/4.ts": ("export function f() {\n  a\n}\nlet z\nexport const q = 1;", "export function f() {\n  a\n}\n\nexport const q = 1;\n"),
        "a/5.ts": ("export class A {\n" + "x\n" * 60 + "}\nexport const b = 1;", "export class A {\nx\nx\nx\nx\n    // ... body elided (long) ...\n\nexport const b = 1;\n"),
        "a/6.ts": ("export a {\nexport b {\n}}\nexport c", "export a {\nexport b {\n}}\n\nexport c\n"),
        "a/7.rb": ("class A\n  def b\n  x\nmodule C", "class A\n  def b\nmodule C"),
    }
    files = spark.createDataFrame([(1, k, c) for k, (c, _) in cases.items()] + [(1, "a/8.py", None), (1, "a/9.ts", "")], "source_id long, rel string, content string")
    assert {r["rel"]: r["content"] for r in E.signatures(files).collect()} == {k: w for k, (_, w) in cases.items()}
    few = {r["rel"]: r["content"] for r in E.signatures(files, 1).collect()}
    assert few["a/6.ts"] == "export a {\nexport b {\n}}\n" and few["a/7.rb"] == "class A"


def test_extraction(spark):
    md = "# H\ntext `some_name` `yes` `abc`\n```py\n# c\nx\n```\n## H2\n```\ny\n```\n```\nz"
    files = spark.createDataFrame([(1, "a.md", md), (1, "a.html", "<p>no</p>"), (1, "b.html", "<html><p>page</p></html>"), (1, "a/tests/x.py", "def f():\n  1"), (1, "m.py", "def g():\n  1"), (1, "go.mod", "m")], "source_id long, rel string, content string")
    blocks = E.code_blocks(files).first()
    assert blocks["blocks"] == "**# H**\n\n```py\n# c\nx\n```\n\n**## H2**\n\n```\ny\n```\n\n```\nz" and blocks["block_count"] == 2
    assert E.inline_identifiers(files).first()["identifiers"] == ["some_name"]
    assert {r["rel"]: r["content"] for r in E.page_fallback(files).where("kind = 1").collect()} == {"b.html": "page"}
    assert [r["rel"] for r in E.signatures(files).collect()] == ["m.py"]
    text = E.repo_reference(files).first()["text"]
    assert text.index("## Python signatures") < text.index("## Package manifests")
    docs = E.docs_reference(files).first()["text"]
    assert "### From `a.md` (2 code blocks)" in docs and "Full page content" in docs


def test_readers(spark, tmp_path):
    repo = tmp_path / "r"
    for name, data in {"src/main.py": b"x", "a.png": b"x", "node_modules/y.js": b"y", "b.txt": b"a\x00b", "README": b"caf\xff"}.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_bytes(data)
    files = S.walk(S.read_tree(spark, f"file://{repo}"))
    got = {r["rel"]: (r["is_binary"], r["priority"], r["text"]) for r in files.collect()}
    assert set(got) == {"src/main.py", "a.png", "b.txt", "README"} and got["a.png"][0] and got["b.txt"][0] and got["README"] == (False, 0, "caf�")
    tree = S.tree_listing(files.withColumn("source_id", F.lit(1)), "source_id").first()["tree"].split("\n")
    assert tree == ["src/", "  main.py  (1.0 B)", "a.png  (1.0 B)", "b.txt  (3.0 B)", "README  (4.0 B)"]
    nb = spark.createDataFrame([('{"cells":[{"cell_type":"code","source":["a\\n","b"],"outputs":[{"data":{"text/plain":"7"}}]}]}',), ("{bad",), (None,)], "c string")
    assert [r[0] for r in nb.select(S.flatten_notebook("c")).collect()] == ["# Cell 1 [code]\na\nb\n\n# Output of cell 1\n7", "{bad", None]
    m = spark.createDataFrame([(1, "see https://a.b/c. and (https://a.b/c) https://d.e/f,")], "source_id long, text string")
    assert [r["url"] for r in S.expand_manifest(m).orderBy("place").collect()] == ["https://a.b/c", "https://d.e/f"]
    html = '<a href="/docs/b">b</a><a href="/docs/c.png">c</a><a href="http://other/docs">o</a><a href="#x">x</a>'
    pages = spark.createDataFrame([("https://h/docs/a", html), ("https://h/docs/b", '<a href="/docs/d">d</a>'), ("https://h/docs/d", "")], "url string, html string")
    roots = spark.createDataFrame([(1, "https://h/docs/a")], "source_id long, url string")
    assert [r["url"] for r in S.crawl(pages, roots, 10).orderBy("place").collect()] == ["https://h/docs/a", "https://h/docs/b", "https://h/docs/d"]
    assert S.crawl(pages, roots, 2).count() == 2
    got = S.fetch(roots, lambda u: {"html": "x"} if u else 1 / 0).first()
    assert got["html"] == "x" and got["error"] is None
    tried = S.fetch(spark.createDataFrame([("https://a/x",), ("https://a/y.txt",), ("https://a/z",)], "url string"), lambda u: 1 / 0, lambda u: {"html": u, "method": "http"} if u.endswith("x") else {}["none"], text=lambda u: {"text": "t", "method": "text"})
    got = {r["url"]: (r["method"], r["html"], r["error"]) for r in tried.collect()}
    assert got == {"https://a/x": ("http", "https://a/x", None), "https://a/y.txt": ("text", None, None), "https://a/z": (None, None, "KeyError: 'none'")}
    whole = spark.createDataFrame([("docs/a.txt", 10, bytearray(b"x")), ("src/b.py", 90, bytearray(b"y"))], "rel string, bytes long, content binary")
    assert {r["rel"]: r["is_binary"] for r in S.walk(whole, (), 50).collect()} == {"docs/a.txt": True, "src/b.py": False}
    bundle = B.web_bundles(spark.createDataFrame([(1, 1, "u", "A"), (1, 2, "v", "B"), (2, 1, "w", "C")], "source_id long, place int, url string, markdown string"))
    assert {r["source_id"]: r["text"] for r in bundle.collect()}[2] == "C"


def test_dispatch_without_tables(spark):
    from groundling.sources.dispatch import download
    from groundling.sources.routing import read_list, route, single_source

    routed = route(spark.createDataFrame([(1, "a.org/x"), (2, "odd one"), (3, "1412.6550")], "source_id long, raw string"))
    got = {r["source_id"]: (r["text"], r["error"]) for r in download(routed).collect()}
    assert got == {1: (None, "nothing fetched for kind=web"), 2: (None, "Cannot download kind=unknown"), 3: (None, "nothing fetched for kind=arxiv")}
    pages = spark.createDataFrame([], "source_id long, place int, url string, markdown string")
    assert {r["source_id"]: r["text"] for r in download(routed, pages=pages).collect()}[1] == ""
    assert single_source(arxiv="a", url="u") == ("a", False) and single_source(pdf="p") == ("p", True) and single_source() == (None, False)


def test_batch_list_and_writers(spark, tmp_path):
    from groundling.sources.routing import read_list

    (tmp_path / "list.txt").write_text("# c\n\n  a.org \n1412.6550\n")
    assert [r["raw"] for r in read_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.org", "1412.6550"]
    bundles = spark.createDataFrame([(1, "web", "t"), (2, "pdf", None)], "source_id long, kind string, text string")
    files = spark.createDataFrame([(1, "a/b.md", "x"), (1, "../../etc/x", "bad"), (1, "..", "bad")], "source_id long, rel string, content string")
    R.write_bundles(bundles, files, str(tmp_path / "b"))
    assert {r["rel"] for r in spark.read.parquet(str(tmp_path / "b/files")).collect()} == {"a/b.md"} and spark.read.parquet(str(tmp_path / "b/bundles")).count() == 2
    R.write_json(spark.createDataFrame([("web", 91.26, None)], "kind string, pct_verified double, error string"), str(tmp_path / "j"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"kind":"web","pct_verified":91.3}']
    R.write_texts(bundles, "text", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_registered_functions(spark):
    from groundling.functions.register import register

    register(spark)
    html = "<style>a{}</style><p>It\\'s &amp; x&nbsp;</p><!-- c -->\n\n\n\n<b>b</b>".replace("\\", "")
    df = spark.createDataFrame([(html, "Caf\u00c9"), (None, None)], "h string, t string")
    rows = df.selectExpr("strip_html(h) as a", "norm_text(t) as b").collect()
    from groundling.functions import text as X

    assert rows[0]["a"] == df.select(X.strip_html(F.col("h"))).first()[0] == "It's & x\n\nb" and rows[0]["b"] == "cafe" and rows[1]["a"] is None


def test_prompts():
    from groundling.functions import tables as T
    from groundling.operators.prompts import SYSTEM, with_system_prompts

    seen = with_system_prompts(lambda s, p: f"{s}|{p}")
    assert set(SYSTEM) == {"paper", "repo", "web", "repair"} and seen("web", "x") == SYSTEM["web"] + "|x" and seen("own", "x") == "own|x" and T.PAPER_KINDS


def test_streaming(spark, tmp_path):
    from groundling.streaming.ingest import each_batch, routed_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("github.com/a/b\n# c\n\ngithub.com/a/b\n1412.6550\n")
    seen = []
    q = each_batch(routed_stream(spark, str(src)), lambda df, k: seen.extend(r["kind"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == ["arxiv", "github_repo"]


def test_signatures_without_shuffle(spark):
    rows = [(k, f"a/{k}.{x}", c) for k, (x, c) in enumerate([("py", "def f():\n  1"), ("ts", "export a"), ("rb", "class A")])]
    plan = E.signatures(spark.createDataFrame(rows, "source_id long, rel string, content string"))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "Aggregate ", "Join")) and plan.count("Generate") == 1
    odd = {
        "a.py": ("def f():\n'''one\ntwo'''\ndef g(\n", "def f():\n'''one\ntwo'''\n\ndef g(\n"),
        "b.py": ('@a\ndef f():\n"""\ndef inside():\n', '@a\ndef f():\n"""\ndef inside():\n'),
        "c.py": ('class A:\n  """x"""\n  def g(self): pass\nx', 'class A:\n  """x"""\n\n  def g(self): pass\nx\n'),
        "d.ts": ("export a {\n}}\nexport b }\nexport {\nx", "export a {\n}}\nexport b }\nexport {\nx\n"),
        "e.ts": ("export a {\n" * 400 + "export z", "export a {\n" * 5 + "    // ... body elided (long) ...\n"),
    }
    got = E.signatures(spark.createDataFrame([(1, k, c) for k, (c, _) in odd.items()], "source_id long, rel string, content string")).collect()
    assert {r["rel"]: r["content"] for r in got} == {k: w for k, (_, w) in odd.items()}


def test_claims_without_shuffle(spark):
    skills = spark.createDataFrame([(1, DOC), (2, "## \nx `ab` and 'AB c' and \"ab C\"\n---\n## Two ##"), (3, "---\n## In\nname: x"), (4, "\n")], "source_id long, skill_text string")
    lines = C.skill_lines(skills, "source_id")
    claims = C.claims(lines, "source_id")
    plan = claims._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "Aggregate ", "Join")) and plan.count("Generate") == 2
    got = {k: [(r["line_no"], r["line"], r["section"], r["in_yaml"], r["is_skipped"]) for r in lines.where(f"source_id = {k}").orderBy("line_no").collect()] for k in (2, 3, 4)}
    assert got[2] == [(1, "##", "(top)", False, False), (2, "x `ab` and 'AB c' and \"ab C\"", "(top)", False, False), (3, "---", "(top)", False, False), (4, "## Two ##", "Two ##", False, False)]
    assert got[3] == [(1, "---", "(top)", False, True), (2, "## In", "In", True, False), (3, "name: x", "In", True, True)] and got[4] == [(1, "", "(top)", False, False)]
    assert [tuple(r)[1:] for r in claims.where("source_id = 2 and line_no = 2").orderBy("claim_seq").collect()] == [(2, 1, "ab", "code", "ab"), (2, 2, "ab C", "quoted", "ab c")]
