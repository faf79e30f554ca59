"""Registered queries of the source-grounding operators, each with the DuckDB SQL that must give the same rows.

Inputs that the tables do not hold (markdown, repository files, notebooks, listings) are made from their rows by SQL
expressions that both engines share; every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions.batches import small_batches
from ..functions.lineage import cut
from ..operators import bundle as B
from ..operators import claims as C
from ..operators import loop as L
from ..operators import report as R
from ..operators import verbatim as E
from ..operators import verify as V
from ..sources import dispatch as D
from ..sources import readers as S
from ..sources.routing import auth_needed, route, routing_counts
from ..streaming.ingest import event_windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


# ---- expressions that both engines read alike

NL = "chr(10)"
WORD = lambda k: f"split_part(replace(text, chr(10), ' '), ' ', {k})"
SKILL = f" || {NL} || ".join(
    [
        "'---'", "'name: doc-' || cast(doc_id as string)", "'description: uses gRPC and ' || lang", "'---'", "'# Title ' || source",
        f"'Words `' || {WORD(3)} || ' ' || {WORD(4)} || '` and `missing_' || cast(doc_id as string) || '` here'",
        "'## 1. Usage'", f"'Says \"' || {WORD(5)} || ' ' || {WORD(6)} || ' ' || {WORD(7)} || '\" and \"never said so\"'",
        "'See https://example.org/api/' || cast(doc_id as string) || '. or src/main_' || source || '.py now'", "''",
        "'```python'", "'x = 42ms of ' || cast(n_chars as string)", "'```'", "'### Sub `part`'", "'## Notes on ' || lang",
        "'Takes ' || cast(n_chars as string) || 'ms with fooBarBaz and CUDA over 17 runs'", f"'plain ' || {WORD(9)}", "'## Empty'", "'nothing'",
    ]
)
FOLD = lambda c: f"regexp_replace(lower(strip_accents({c})), '[^\\x00-\\x7F]', '', 'g')"


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.selectExpr("doc_id as source_id", f"{SKILL} as skill_text")


SKILLS_SQL = f"docs0 as (select doc_id, coalesce(text, '') as text, lang, source, n_chars from documents), skills as (select doc_id as source_id, {SKILL} as skill_text from docs0)"
LINES_SQL = f"""{SKILLS_SQL}, raw as (
  select source_id, unnest(string_split(skill_text, chr(10))) as line0, generate_subscripts(string_split(skill_text, chr(10)), 1) as line_no from skills
), l0 as (
  select source_id, line_no::int as line_no, rtrim(line0) as line, trim(line0) as s,
         bool_or(line_no = 1 and trim(line0) = '---') over d as opens,
         coalesce(min(case when line_no > 1 and trim(line0) = '---' then line_no end) over d, 2147483647) as ends
  from raw window d as (partition by source_id)
), l1 as (
  select *, opens and line_no < ends and line_no > 1 as in_yaml, starts_with(s, '#') as is_header,
         (opens and (line_no = 1 or line_no = ends)) or (opens and line_no < ends and regexp_matches(s, '^(name|id|version|category|author|date):\\s', 'i')) or starts_with(s, '```') as is_skipped
  from l0
), lines as (
  select source_id, line_no, line, in_yaml, is_header, is_skipped,
         coalesce(last_value(case when starts_with(s, '## ') and not is_skipped then coalesce(nullif(trim(ltrim(s, '# '))[:60], ''), '(unnamed)') end ignore nulls)
           over (partition by source_id order by line_no rows unbounded preceding), '(top)') as section
  from l1
)"""
_NUM = r"(?:^|[^\w.])(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?:%|[a-zA-Z]{1,4})?)(?:[^\w.]|$)"
#: RE2 knows ASCII words only: words with other letters are blanked where word boundaries count.
CLAIMS_SQL = f"""{LINES_SQL}, cand as (
  select source_id, line_no, unnest(v) as c, generate_subscripts(v, 1) as pos from (
    select source_id, line_no, list_concat(list_concat(list_concat(
      [{{'value': x, 'ctype': 'code'}} for x in regexp_extract_all(line, {sql_str(T.CODE)}, 1) if len(trim(x)) >= 2],
      [{{'value': rtrim(x, '.,;)]}}>'), 'ctype': 'url'}} for x in regexp_extract_all(line, {sql_str(T.URL)}, 0)]), list_concat(
      [{{'value': x, 'ctype': 'path'}} for x in regexp_extract_all(line, {sql_str(T.PATH)}, 0) if not starts_with(x, 'http')],
      [{{'value': x, 'ctype': 'quoted'}} for x in regexp_extract_all(line, {sql_str(T.QUOTED)}, 1) if len(trim(x)) >= 3])), list_concat(list_concat(
      [{{'value': x, 'ctype': 'quoted'}} for x in regexp_extract_all(line, {sql_str(T.SINGLE_QUOTED)}, 1) if len(trim(x)) >= 3],
      [{{'value': x, 'ctype': 'number'}} for x in regexp_extract_all(line, {sql_str(_NUM)}, 1) if not list_contains({sql_list(T.TRIVIAL_NUMBERS)}, x)]), list_concat(
      [{{'value': x, 'ctype': 'identifier'}} for x in regexp_extract_all(ascii, {sql_str(T.IDENTIFIER)}, 1) if len(x) >= 4 and not is_header and not in_yaml],
      [{{'value': x, 'ctype': 'acronym'}} for x in {sql_list(T.ACRONYMS)} if list_contains(regexp_extract_all(ascii, '\\w+'), x) and not is_header]))) as v
    from (select *, regexp_replace(line, '[A-Za-z0-9_]*(?:[^\\x00-\\x7F][A-Za-z0-9_]*)+', ' ', 'g') as ascii from lines) where not is_skipped)
), normed as (
  select source_id, line_no, pos, trim(c.value) as value, c.ctype as ctype, {FOLD("trim(c.value)")} as norm_value from cand
), claims as (
  select source_id, line_no, (row_number() over (partition by source_id, line_no order by pos))::int as claim_seq, value, ctype, norm_value from (
    select *, row_number() over (partition by source_id, line_no, norm_value order by pos) as n from normed
    where norm_value <> '' and not list_contains({sql_list(T.STOPWORDS)}, norm_value)) where n = 1
)"""
VERIFIED_SQL = f"""{CLAIMS_SQL}, folded as (select doc_id as source_id, {FOLD("text")} as src, regexp_replace({FOLD("text")}, '\\s+', ' ', 'g') as flat from docs0
), verified as (
  select c.*, case
    when trim(norm_value) = '' then true
    when ctype = 'url' then contains(src, rtrim(trim(norm_value), '.,;)]}}>'))
    when ctype = 'number' then contains(src, regexp_extract(norm_value, '^\\d+(\\.\\d+)?(e[-+]?\\d+)?')) and (
      regexp_matches(src, '(^|[^0-9.e+-])' || regexp_escape(norm_value) || '([^0-9.e]|$)')
      or regexp_matches(src, '(^|[^0-9.e+-])' || regexp_escape(regexp_extract(norm_value, '^\\d+(\\.\\d+)?(e[-+]?\\d+)?')) || '([^0-9.e]|$)'))
    else contains(flat, regexp_replace(trim(norm_value), '\\s+', ' ', 'g'))
      and regexp_matches(flat, '(^|[^a-z0-9_])' || regexp_escape(regexp_replace(trim(norm_value), '\\s+', ' ', 'g')) || '([^a-z0-9_]|$)') end as verified
  from claims c join folded using (source_id)
)"""
PCT = lambda u, t: f"(case when {t} > 0 then (1.0::double - {u}::double / {t}::double) * 100 else 100.0::double end)"
SECTIONS_SQL = f"""{VERIFIED_SQL}, per_line as (
  select source_id, line_no, count(*) as t, count(*) filter (where not verified) as u from verified group by all
), sections as (
  select source_id, section, min(l.line_no)::int as first_line, coalesce(sum(t), 0)::bigint as claims_total, coalesce(sum(u), 0)::bigint as claims_unverified,
         count(*)::bigint as lines, count(*) filter (where u > 0)::bigint as flagged_lines, {PCT("coalesce(sum(u), 0)", "coalesce(sum(t), 0)")} as pct_verified
  from lines l left join per_line using (source_id, line_no) where not is_skipped group by source_id, section
)"""


# ---------------------------------------------------------------- flagship


@query(f"""
with items as (select item_id, trim(regexp_replace({FOLD("text")}, '\\s+', ' ', 'g')) as v from benchmark),
docs as (select doc_id, regexp_replace({FOLD("coalesce(text, '')")}, '\\s+', ' ', 'g') as flat from documents),
hits as (select item_id, count(*) as n_docs, min(doc_id) as first_doc from items join docs on v <> '' and contains(flat, v)
  and regexp_matches(flat, '(^|[^a-z0-9_])' || regexp_escape(v) || '([^a-z0-9_]|$)') group by item_id)
select item_id, coalesce(n_docs, 0)::bigint as n_docs, first_doc from items left join hits using (item_id)
""")
def verify_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quoted claims against all documents, by an index on the passages' words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.norm_text(F.coalesce("text", F.lit(""))).alias("norm_src"))
    items = table(spark, sf_dir, "benchmark").select("item_id", X.norm_text("text").alias("v"))
    return V.passage_hits(docs, items)


# ---------------------------------------------------------------- routing and urls

_SAMPLES = [
    "1412.6550", "2103.13630v2", "https://arxiv.org/pdf/2103.13630.pdf", "github.com/a", "github.com/a/b/blob/main/x/README.md", "https://github.com/a/b/tree/feature/x", "https://github.com/a/b/pull/7/files",
    "https://github.com/a/b/wiki/Home", "docs.x.io/llms.txt", "notes.MD", "missing.pdf", "hello world", "", "# comment", "  https://github.com/a/b/issues/3 ", "https://a.org/x.pdf", "notes.txt", "https://b.org/r.md", "arxiv.org/help",
]
ROUTE_SQL = rf"""r0 as (select raw, trim(raw) as s, case when starts_with(trim(raw), 'http') then trim(raw) else 'https://' || trim(raw) end as f from raws),
r1 as (select *, regexp_matches(f, {sql_str(T.GITHUB_URL)}) as g, regexp_extract(f, {sql_str(T.GITHUB_URL)}, 1) as o, regexp_extract(f, {sql_str(T.GITHUB_URL)}, 2) as p,
  regexp_extract(f, {sql_str(T.GITHUB_URL)}, 3) as form, regexp_extract(f, {sql_str(T.GITHUB_URL)}, 4) as rest, regexp_extract(s, {sql_str(T.ARXIV_URL)}, 1) as ax from r0),
routed as (select raw, case when s = '' or starts_with(s, '#') then 'skip' when regexp_matches(s, {sql_str(T.ARXIV_ID)}) then 'arxiv' when contains(s, 'arxiv.org') and ax <> '' then 'arxiv'
  when g and p = '' then 'github_org' when g and form in ('blob', 'raw') then 'github_blob' when g and form = 'pull' then 'github_pr' when g then 'github_repo'
  when ends_with(lower(s), 'llms.txt') then 'llms_manifest' when ends_with(s, '.txt') or ends_with(s, '.md') then 'text' when ends_with(lower(s), '.pdf') and starts_with(s, 'http') then 'pdf'
  when starts_with(s, 'http') or (regexp_matches(s, {sql_str(T.DOMAIN_LIKE)}) and not contains(s, ' ')) then 'web' else 'unknown' end as kind, s, f, o, p, form, rest, ax from r1)"""
_RAWS = f"raws as (select unnest({sql_list(_SAMPLES)}) as raw union all select url from pages)"


def _raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in _SAMPLES], "raw string").union(table(spark, sf_dir, "pages").select("url"))


@query(f"""with {_RAWS}, {ROUTE_SQL} select raw, kind,
  case when kind = 'skip' then '' when kind = 'arxiv' then 'https://arxiv.org/abs/' || coalesce(nullif(case when regexp_matches(s, {sql_str(T.ARXIV_ID)}) then split_part(s, 'v', 1) else ax end, ''), '')
    when kind = 'github_org' then 'https://github.com/' || o when kind = 'github_pr' then 'https://github.com/' || o || '/' || p || '/pull/' || split_part(rest, '/', 1)
    when starts_with(kind, 'github') then 'https://github.com/' || o || '/' || p else f end as url,
  case when kind = 'arxiv' then case when regexp_matches(s, {sql_str(T.ARXIV_ID)}) then split_part(s, 'v', 1) else ax end end as arxiv_id,
  case when kind = 'github_blob' or (kind = 'github_repo' and form = 'tree') then split_part(rest, '/', 1) end as ref,
  case when kind = 'github_blob' then case when contains(rest, '/') then substr(rest, strpos(rest, '/') + 1) else '' end end as path,
  case when kind = 'github_pr' then split_part(rest, '/', 1) end as pr from routed""")
def route_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route(_raws(spark, sf_dir)).select("raw", "kind", "url", "arxiv_id", "ref", "path", "pr")


@query(f"with {_RAWS}, {ROUTE_SQL} select kind, count(*)::bigint as n from routed group by kind")
def routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing_counts(route(_raws(spark, sf_dir)))


@query(f"with {_RAWS}, {ROUTE_SQL} select count(*)::bigint as n from routed where kind in ('github_pr', 'github_org', 'github_blob')")
def auth_needed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_needed(route(_raws(spark, sf_dir)))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_NORM = r"lower(regexp_replace(regexp_replace({}, '#.*$', ''), '/+$', ''))"
_ANY = lambda c, vs: "(" + " or ".join(f"contains({c}, '{v}')" for v in vs) + ")"
_PREFIX = "coalesce(" + ", ".join(f"case when contains(rtrim({_PATH}, '/'), '{p}') then split_part(rtrim({_PATH}, '/'), '{p}', 1) || '{p}' end" for p in T.CRAWL_PREFIXES) + ", '')"


@query(f"""select page_id, {_NORM.format("url")} as norm_url, ({_ANY(f"lower({_PATH})", T.DOCS_PATHS)} or {_ANY(_HOST, T.DOCS_HOSTS)}) as is_docs, {_PREFIX} as prefix,
  trim(regexp_replace(regexp_replace(url, 'https?://', ''), '[^a-zA-Z0-9._-]+', '_', 'g'), '_')[:80] as slug, md5(url)[:8] as hash from pages""")
def url_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url(u).alias("norm_url"), X.is_docs_url(u).alias("is_docs"), X.crawl_prefix(u).alias("prefix"), X.slugify(u).alias("slug"), X.short_hash(u).alias("hash"))


@query(f"select {_NORM.format('url')} as norm_url, count(*)::bigint as n, min(page_id) as first_page from pages group by 1")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(X.normalize_url(F.col("url")).alias("norm_url")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


#: Anchors in all three forms behind each page's own; the oracle reads tags and addresses by splitting, not by the pattern.
_ANCHORS = """coalesce(html, '') || '<a class=x HREF = ' || chr(39) || '/single/' || page_id || chr(39) || '>s</a><A id=b href=/bare/' || page_id || '.html>b</A><a href="/amp?x=1&amp;y=' || page_id || '">c</a><a href=' || chr(39) || '#top' || chr(39) || '>t</a><a name=k>n</a><a href="mailto:a@b.c">m</a>'"""
_HREFS = f"""tags as (select page_id, url, unnest(t) as tag, generate_subscripts(t, 1) as nth from (
  select page_id, url, string_split(regexp_replace({_ANCHORS}, '<[aA] ', chr(1) || ' ', 'g'), chr(1))[2:] as t from pages)),
attrs as (select page_id, url, nth, regexp_replace(split_part(tag, '>', 1), '(?i) href *= *', chr(2)) as t from tags),
found as (select page_id, url, (row_number() over (partition by page_id order by nth) - 1)::int as pos, split_part(t, chr(2), 2) as v from attrs where contains(t, chr(2))),
links as (select page_id, url, pos, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href as link from (
  select page_id, url, pos, trim(replace(case left(v, 1) when '"' then split_part(v, '"', 2) when chr(39) then split_part(v, chr(39), 2) else split_part(v, ' ', 1) end, '&amp;', '&')) as href from found)
  where href <> '' and left(href, 1) <> '#' and not starts_with(href, 'javascript:') and not starts_with(href, 'mailto:') and not starts_with(href, 'tel:'))"""


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_ANCHORS} as html")


@query(f"with {_HREFS} select page_id, pos, href, link from links")
def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pages link by absolute paths only, which is what the oracle resolves."""
    return S.extract_links(_linked_pages(spark, sf_dir)).select("page_id", "pos", "href", "link")


@query(
    f"with {_HREFS} select page_id, count(*)::bigint as n_links, (count(*) filter (where not ("
    + " or ".join(f"ends_with(lower(link), '{e}')" for e in T.NO_FOLLOW)
    + f") and starts_with({_PATH.replace('url', 'link')}, {_PREFIX})))::bigint as n_followed from links group by page_id"
)
def links_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = S.extract_links(_linked_pages(spark, sf_dir))
    ok = X.may_follow(F.col("link"), X.url_host(F.col("url")), X.crawl_prefix(F.col("url")))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(ok).alias("n_followed"))


@query()
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped breadth-first crawl from the first page of each host over the stored pages."""
    pages = table(spark, sf_dir, "pages").where("url is not null")
    roots = pages.groupBy(X.url_host(F.col("url")).alias("host")).agg(F.min(F.struct("page_id", "url")).alias("r")).select(F.col("r.page_id").alias("source_id"), "r.url")
    return S.crawl(pages, roots, 25)


@query("""with recursive hosts as (select lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as h, list(page_id order by page_id) as ids from pages group by 1),
  edge as (select ids[i] as a, ids[2 * i] as b from (select ids, unnest(range(1, len(ids) + 1)) as i from hosts) where 2 * i <= len(ids) and ids[i] % 5 <> 3), roots as (select ids[1] as root from hosts),
  reach as (select root, root as node from roots union select r.root, e.b from reach r join edge e on e.a = r.node)
select root, count(*)::bigint as n from reach group by root""")
def crawl_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncapped reachable set: the i-th page of a host leads to the 2i-th, but for some that lead nowhere."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "pages").select(X.url_host(F.col("url")).alias("h"), "page_id")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("h").orderBy("page_id")))
    to = rows.select("h", (F.col("i") / 2).alias("i"), F.col("page_id").alias("b"))
    links = rows.join(to, ["h", "i"]).where("page_id % 5 <> 3").select(F.col("page_id").alias("a"), "b")
    return S.reachable(links, rows.where("i = 1").select(F.col("page_id").alias("root"))).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with m as (select lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) as host, string_agg('- [p](' || url || '), see ' || url || '.', chr(10) order by page_id) as text from pages group by 1),
 u as (select host, unnest(l) as url, generate_subscripts(l, 1) as pos from (select host, regexp_extract_all(text, {sql_str(T.MANIFEST_URL)}) as l from m)),
 once as (select host, regexp_replace(url, '[.,;)]+$', '') as url, min(pos) as pos from u group by 1, 2)
select host, place::int as place, url from (select *, row_number() over (partition by host order by pos) as place from once) where place <= 50""")
def manifest_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("- [p]("), "url", F.lit("), see "), "url", F.lit("."))
    g = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)).alias("host"), "page_id", line.alias("t")).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("page_id", "t"))).alias("l"))
    m = g.select(F.col("host").alias("source_id"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))
    return S.expand_manifest(m, 25).withColumnRenamed("source_id", "host")


# ---------------------------------------------------------------- scalar text functions

_STRIPPED = "html"
for _t in ("script", "style", "svg", "noscript"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', '', 'g')"
_STRIPPED = f"regexp_replace(regexp_replace({_STRIPPED}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')"
for _a, _b in T.NAMED_ENTITIES:
    _STRIPPED = f"replace({_STRIPPED}, {sql_str(_a)}, {sql_str(_b)})"
_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"select page_id, {_STRIPPED} as text from pages")
def strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(f"""select page_id, (regexp_matches(lower(ltrim(html)[:200]), '^(<!doctype|<html|<[?]xml)') or len(regexp_extract_all(html, {sql_str(T.STRUCTURAL_TAG)})) >= 8) as is_html,
  len(regexp_extract_all(html, {sql_str(T.STRUCTURAL_TAG)}))::int as n_tags from pages""")
def html_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.looks_like_html(F.col("html")).alias("is_html"), F.regexp_count("html", F.lit(T.STRUCTURAL_TAG)).alias("n_tags"))


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(table(spark, sf_dir, "pages")).select("page_id", X.html_to_markdown("html").alias("markdown"))


@query(f"select doc_id, {FOLD('text')} as norm, md5(text)[:6] as hash from documents")
def norm_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.norm_text("text").alias("norm"), X.short_hash(F.col("text"), 6).alias("hash"))


@query("""select o_orderkey, x::bigint as n, case when x < 1024 then printf('%.1f B', x) when x < 1048576 then printf('%.1f KB', x / 1024) when x < 1073741824 then printf('%.1f MB', x / 1048576) else printf('%.1f GB', x / 1073741824) end as shown
from (select o_orderkey, floor(o_totalprice * o_totalprice)::double as x from orders)""")
def sizeof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.floor(F.col("o_totalprice") * F.col("o_totalprice")).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("n"), X.sizeof(x).alias("shown"))


_PART_PATH = "replace(p_name, ' ', '/') || case when p_partkey % 7 = 0 then '/../../../x' else '' end"


@query(f"""with recursive p as (select p_partkey, string_split('/base/dir/' || {_PART_PATH}, '/') as parts from part),
f as (select p_partkey, parts, 1 as i, []::varchar[] as acc from p union all
  select p_partkey, parts, i + 1, case when parts[i] in ('', '.') then acc when parts[i] = '..' then acc[:greatest(len(acc) - 1, 0)] else list_append(acc, parts[i]) end from f where i <= len(parts))
select p_partkey, case when '/' || array_to_string(acc, '/') = '/base/dir' or starts_with('/' || array_to_string(acc, '/'), '/base/dir/') then '/' || array_to_string(acc, '/') end as target from f where i = len(parts) + 1""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PART_PATH} as rel").select("p_partkey", X.safe_join("/base/dir", F.col("rel")).alias("target"))


@query(f"""select source_id, regexp_extract(regexp_extract(skill_text, '(?s)^---\\s*\\r?\\n(.*?)\\r?\\n---\\s*\\r?\\n', 1), '(?m)^name:\\s*(.+)$', 1) as name,
 '```markdown' || chr(10) || skill_text || chr(10) || '```' as fenced, trim(skill_text) as cleaned from (with {SKILLS_SQL} select * from skills)""")
def generated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```markdown\n"), "skill_text", F.lit("\n```"))
    return skills(spark, sf_dir).select("source_id", X.skill_name(F.col("skill_text")).alias("name"), fenced.alias("fenced"), X.clean_output(fenced).alias("cleaned"))


_NOTE = """case cast((conv_id + turn) % 4 as int)
 when 0 then '{"cells":[{"cell_type":"code","source":["a = ' || cast(conv_id as string) || '","; b"],"outputs":[{"text":["out ' || role || '"," more"]}]},{"cell_type":"markdown","source":"# t"},{"cell_type":"code","source":[],"outputs":[{"data":{"text/plain":"7"}}]}]}'
 when 1 then '{"cells":[{"source":"turn ' || cast(turn as string) || '","outputs":[{"text":"","data":{"text/plain":["p","' || role || '"]}},{"name":"none"}]},{"cell_type":"raw"}]}'
 when 2 then '{"cells":[{"cell_type":"code","source":"x","outputs":[{"text":"' || repeat(role, 600) || '"}]}]}'
 else case when turn % 2 = 0 then '{"metadata":{}}' else 'no notebook ' || role end end"""


@query(f"""select conv_id, turn, case (conv_id + turn) % 4
 when 0 then '# Cell 1 [code]' || {NL} || 'a = ' || conv_id || '; b' || {NL} || {NL} || '# Output of cell 1' || {NL} || 'out ' || role || ' more' || {NL} || {NL} || '# Cell 2 [markdown]' || {NL} || '# t' || {NL} || {NL} || '# Output of cell 3' || {NL} || '7'
 when 1 then '# Cell 1 [?]' || {NL} || 'turn ' || turn || {NL} || {NL} || '# Output of cell 1' || {NL} || 'p' || role
 when 2 then '# Cell 1 [code]' || {NL} || 'x' || {NL} || {NL} || '# Output of cell 1' || {NL} || repeat(role, 600)[:2000]
 else case when turn % 2 = 0 then '' else 'no notebook ' || role end end as flat from conversations""")
def notebooks_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and outputs as strings and as lists, missing parts, long outputs, a notebook without cells, and what is none."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_NOTE} as nb").select("conv_id", "turn", S.flatten_notebook("nb").alias("flat"))


@query("""select conv_id, turn, '{"id": ' || conv_id || ', "r": {"t": ' || turn || '}}' as json from conversations""")
def json_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit('Sure:\n```json\nHere {"id": '), F.col("conv_id").cast("string"), F.lit(', "r": {"t": '), F.col("turn").cast("string"), F.lit("}} done\n```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.parse_json(answer).alias("json"))


# ---------------------------------------------------------------- files, packing, bundles

_EXT = "case cast(p_size % 9 as int) when 0 then '.py' when 1 then '.ts' when 2 then '.md' when 3 then '.png' when 4 then '.toml' when 5 then '.rs' when 6 then '.rb' when 7 then '.data' else '.d.ts' end"
_DIR = "case cast(p_partkey % 8 as int) when 0 then 'src/' when 1 then 'tests/' when 2 then 'docs/' when 3 then 'node_modules/' when 4 then '' when 5 then 'examples/' when 6 then 'lib/core/' else 'model/' end"
_REL = f"{_DIR} || replace(p_name, ' ', '_') || cast(p_partkey as string) || {_EXT}"
_PRIO = "case " + " ".join(f"when regexp_matches(rel, {sql_str('(?i)' + p)}) then {n}" for p, n in T.FILE_PRIORITY) + " else 50 end"
_FILES_SQL = f"""files0 as (select p_partkey % 40 as source_id, {_REL} as rel, p_size::bigint * 1000 as bytes from part),
files1 as (select *, ({_PRIO})::int as priority, regexp_extract(rel, '[^/.][^/]*?(\\.[^./]+)$', 1) as ext from files0
  where not list_has_any(string_split(rel, '/')[:-2], {sql_list(T.SKIP_DIRS)}))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey % 40 as source_id", f"{_REL} as rel", "cast(p_size as long) * 1000 as bytes", "cast(p_name as binary) as content")


@query(f"""with {_FILES_SQL}, b as (select *, (lower(ext) in {tuple(T.BINARY_EXTS)} or (sum(bytes) over (partition by source_id) > 100000 and priority > 8)) as is_binary from files1)
select source_id, rel, bytes, priority, is_binary, (row_number() over (partition by source_id order by priority, rel))::int as place from b""")
def repo_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = S.walk(_files(spark, sf_dir), ("source_id",), 100_000)
    return S.priority_order(walked, "source_id").select("source_id", "rel", "bytes", "priority", "is_binary", "place")


@query(f"with {_FILES_SQL} select source_id, sum(bytes)::bigint as bytes from files1 group by source_id")
def repo_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repo_size(_files(spark, sf_dir), "source_id")


@query(f"""with {_FILES_SQL}, f as (select distinct source_id, rel, bytes from files1), d as (
  select distinct source_id, string_split(rel, '/')[:i] as parts, true as folder, null::bigint as bytes from f, generate_series(1, 5) g(i) where i < len(string_split(rel, '/'))),
e as (select * from d union all select source_id, string_split(rel, '/'), false, bytes from f),
l as (select source_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: (case when i < len(parts) or folder then '0' else '1' end) || lower(parts[i]) || chr(1) || parts[i]), chr(2)) as o,
  repeat('  ', len(parts) - 1) || parts[-1] || case when folder then '/' else '  (' || case when bytes < 1024 then printf('%.1f B', bytes::double) else printf('%.1f KB', bytes::double / 1024) end || ')' end as line from e)
select source_id, string_agg(line, chr(10) order by o) as tree from l group by source_id""")
def repo_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tree_listing(_files(spark, sf_dir).select("source_id", "rel", "bytes").distinct(), "source_id")


_BODY = "'# Repository: a/b' || chr(10) || chr(10) || '## File contents (priority-ordered)' || chr(10) || chr(10) || '### `a.py`' || chr(10) || substring(text, 1, 300) || chr(10) || '### `b.py`' || chr(10) || text || chr(10) || '### `c.py`' || chr(10) || substring(text, 1, 100) || chr(10)"
_HDR = "'# Repository: a/b' || chr(10) || chr(10) || '## File contents (priority-ordered)' || chr(10)"


@query(f"""with b as (select doc_id, {_BODY} as body, length({_HDR}) as h, [chr(10), '### `a.py`' || chr(10) || substring(text, 1, 300) || chr(10), '### `b.py`' || chr(10) || text || chr(10), '### `c.py`' || chr(10) || substring(text, 1, 100) || chr(10)] as secs
  from (select doc_id, coalesce(text, '') as text from documents)),
k1 as (select *, h + length(secs[1]) as u1 from b), k2 as (select *, u1 + length(secs[2]) <= 1500 as t2, u1 + case when u1 + length(secs[2]) <= 1500 then length(secs[2]) else 0 end as u2 from k1),
k3 as (select *, u2 + length(secs[3]) <= 1500 as t3, u2 + case when u2 + length(secs[3]) <= 1500 then length(secs[3]) else 0 end as u3 from k2), k4 as (select *, u3 + length(secs[4]) <= 1500 as t4 from k3)
select doc_id, case when length(body) <= 2000 then body else {_HDR} || secs[1] || case when t2 then secs[2] else '' end || case when t3 then secs[3] else '' end || case when t4 then secs[4] else '' end
 || chr(10) || chr(10) || '> ' || ((not t2)::int + (not t3)::int + (not t4)::int)::varchar || ' lower-priority file section(s) elided to fit LLM input budget; full source on disk under .sources/.' || chr(10) || chr(10) end as packed from k4""")
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.selectExpr("doc_id", f"{_BODY} as body").select("doc_id", X.pack_sections(F.col("body"), 2000).alias("packed"))


@query("""select doc_id, case when length(text) <= 1000 then text else text[:550] || chr(10) || chr(10) || '[... ' || format('{:,}', length(text) - 950) || ' chars elided; full source on disk ...]' || chr(10) || chr(10) || right(text, 400) end as cut from documents""")
def truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.head_tail(F.col("text"), 1000).alias("cut"))


_KWS = ", ".join(f"case when strpos(substr(text, 801), '{k}') > 0 and strpos(substr(text, 801), '{k}') + 799 < n - 600 then strpos(substr(text, 801), '{k}') + 799 end" for k in T.PAPER_KEYWORDS)
_PAPER = "text || case cast(doc_id % 4 as int) when 0 then repeat(' x', 300) || ' Algorithm ' || text || repeat(' y', 500) when 1 then ' Method ' || text when 2 then repeat(text, 2) || ' We propose it' else '' end"


@query(f"""with a as (select doc_id, {_PAPER} as text from documents), n as (select *, length(text) as n from a), k as (select *, coalesce({_KWS}, n // 2) as kw from n),
s as (select *, greatest(800, kw - 150) as st from k), e as (select *, least(n - 600, st + 300) as en from s)
select doc_id, case when n <= 2000 then text else text[:800] || {NL} || {NL} || '[... elided ' || format('{{:,}}', st - 800) || ' chars; full source on disk ...]' || {NL} || {NL} || case when en > st then substr(text, st + 1, en - st) else '' end
 || {NL} || {NL} || '[... elided ' || format('{{:,}}', n - 600 - en) || ' chars ...]' || {NL} || {NL} || right(text, 600) end as cut from e""")
def truncate_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 2000: 800 head, 600 tail, and 300 around a keyword, an early one, a late one, or the midpoint."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PAPER} as text").select("doc_id", X.paper_truncate(F.col("text"), 2000).alias("cut"))


@query(f"""with {_FILES_SQL}, b as (select *, lower(ext) in {tuple(T.BINARY_EXTS)} as is_binary from files1),
body as (select source_id, string_agg('### `' || rel || '`' || chr(10) || chr(10) || '```' || lower(ltrim(ext, '.')) || chr(10) || 'x' || chr(10) || '```' || chr(10), chr(10) order by priority, rel) as body, count(*) as n from b where not is_binary group by source_id),
inv as (select source_id, string_agg('- `' || rel || '` (' || case when bytes < 1024 then printf('%.1f B', bytes::double) else printf('%.1f KB', bytes::double / 1024) end || ')', chr(10) order by rel) filter (where k <= 200) as inv, count(*) as m
  from (select *, row_number() over (partition by source_id order by rel) as k from b where is_binary) group by source_id),
s as (select distinct source_id from files1)
select source_id, '# Repository: o/r' || chr(10) || 'URL: https://x' || chr(10) || 'Files: ' || coalesce(n, 0) || ' text, ' || coalesce(m, 0) || ' binary/excluded' || chr(10) || chr(10) || '## Directory tree' || chr(10) || '```' || chr(10) || 'T' || chr(10) || '```'
 || case when m > 0 then chr(10) || chr(10) || '## Binary / excluded inventory' || chr(10) || inv else '' end || case when m > 200 then chr(10) || '- … +' || (m - 200) || ' more' else '' end
 || chr(10) || chr(10) || '## File contents (priority-ordered)' || chr(10) || coalesce(chr(10) || body, '') as text, coalesce(n, 0)::bigint as n_files, coalesce(m, 0)::bigint as n_binaries from s left join body using (source_id) left join inv using (source_id)""")
def bundle_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.walk(_files(spark, sf_dir)).withColumn("text", F.when(~F.col("is_binary"), "x"))
    repos = files.select("source_id").distinct().withColumns({"owner": F.lit("o"), "repo": F.lit("r"), "url": F.lit("https://x"), "tree": F.lit("T"), "extra_text": F.lit("")})
    return B.repo_bundles(repos, files).select("source_id", "text", "n_files", "n_binaries")


_HOSTED = "regexp_extract(url, '^[a-z]+://([^/]*)', 1)"


@query(f"""with p as (select {_HOSTED} as source_id, row_number() over (partition by {_HOSTED} order by page_id) as place, count(*) over (partition by {_HOSTED}) as n, url, {_STRIPPED} as md from pages)
select source_id, string_agg(case when n = 1 then md else chr(10) || chr(10) || '===== PAGE ' || place || '/' || n || ' — ' || url || ' =====' || chr(10) || chr(10) || md end, '' order by place) as text, count(*)::bigint as pages_crawled from p group by source_id""")
def bundle_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.web_bundles(_hosted(spark, sf_dir))


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    pages = table(spark, sf_dir, "pages").withColumn("source_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1))
    return pages.select("source_id", F.row_number().over(Window.partitionBy("source_id").orderBy("page_id")).alias("place"), "url", "html", X.strip_html(F.col("html")).alias("markdown"))


@query(f"""with p as (select {_HOSTED} as source_id, row_number() over (partition by {_HOSTED} order by page_id) as place, count(*) over (partition by {_HOSTED}) as n, url, html from pages)
select source_id, case when n = 1 then 'page.md' else 'page_' || lpad(place::varchar, 3, '0') || '_' || trim(regexp_replace(regexp_replace(url, 'https?://', ''), '[^a-zA-Z0-9._-]+', '_', 'g'), '_')[:60] || '.md' end as rel from p
union all select source_id, 'page.html' from p where n = 1 and html <> ''""")
def bundle_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_files(_hosted(spark, sf_dir)).select("source_id", "rel")


# ---------------------------------------------------------------- listings and comments


@query("""with l as (select o_custkey % 20 as owner, 1 + (o_orderkey % 12) as page, o_orderkey as pos, 'repo' || o_orderkey as name, o_orderstatus = 'F' as fork, o_orderpriority = '1-URGENT' as archived from orders)
select owner, place::int as place, name from (select *, row_number() over (partition by owner order by page, pos) as place from l where not fork and not archived and page < 10) where place <= 25""")
def org_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "orders").selectExpr("o_custkey % 20 as owner", "1 + (o_orderkey % 12) as page", "o_orderkey as pos", "'repo' || o_orderkey as name", "o_orderstatus = 'F' as fork", "o_orderpriority = '1-URGENT' as archived")
    return S.org_repos(l)


@query("""with c as (select conv_id % 7 as pr, case when turn % 2 = 0 then 'review' else 'issue' end as kind, row_number() over (partition by conv_id % 7, turn % 2 order by conv_id, turn) as place, role, text from conversations)
select pr, count(*)::bigint as n, string_agg('### ' || role || case when kind = 'review' then ' on f.py' else '' end || ':' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by case when kind = 'review' then 0 else 1 end, place) as text from c where place <= 200 group by pr""")
def pr_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumns({"pr": F.col("conv_id") % 7, "kind": F.when(F.col("turn") % 2 == 0, "review").otherwise("issue")})
    pos = F.row_number().over(Window.partitionBy("pr", "kind").orderBy("conv_id", "turn"))
    body = F.to_json(F.struct(F.struct(F.col("role").alias("login")).alias("user"), F.lit("f.py").alias("path"), F.col("text").alias("body")))
    return S.review_comments(c.select("pr", "kind", pos.alias("pos"), body.alias("body_json")))


# ---------------------------------------------------------------- sources of every kind

_BLOB = "doc_id as source_id, case when doc_id % 3 = 0 then 'src/missing.py' else 'src/f' || cast(doc_id % 2 as string) || '.py' end as path"


@query(f"""with b as (select {_BLOB} from documents), f as (select doc_id as source_id, 'src/f' || k || '.py' as path, coalesce(text, '') || k as content from documents, (values (0), (1)) v(k))
select source_id, path, '### Primary file (from blob URL): `' || path || '`' || {NL} || {NL} || content || {NL} as extra_text from b left join f using (source_id, path)""")
def blob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.selectExpr("doc_id as source_id", "explode(array(0, 1)) as k", "text").selectExpr("source_id", "'src/f' || k || '.py' as rel", "coalesce(text, '') || k as content")
    return S.primary_file(docs.selectExpr(f"inline(array(struct({_BLOB})))"), files).select("source_id", "path", "extra_text")


_PR = "case when turn % 5 = 0 then null else 'T ' || role end as title, case when turn % 2 = 0 then null else text end as body, case when turn % 3 = 0 then '' else '+ ' || text end as diff, case when turn % 4 = 0 then null else '### a:' || chr(10) || role end as comments"


@query(f"""with p as (select conv_id, turn, {_PR} from conversations)
select conv_id, turn, concat_ws({NL} || {NL}, case when title is not null then '# PR #' || turn || ': ' || title || {NL} || {NL} || coalesce(body, '') || {NL} end,
 case when coalesce(diff, '') <> '' then '## Diff' || {NL} || {NL} || '```diff' || {NL} || diff || {NL} || '```' end, case when comments is not null then '## Review comments' || {NL} || {NL} || comments end) as extra_text from p""")
def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"inline(array(struct({_PR})))")
    return p.select("conv_id", "turn", S.pull_request_text(F.col("title"), F.col("body"), F.col("diff"), F.col("comments"), F.col("turn").cast("string")).alias("extra_text"))


_PAPERS = "doc_id as source_id, case when doc_id % 4 = 0 then null else text end as ar5iv, repeat(text, 2) as other, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null else 'pdf of ' || lang end as pdf_text"


@query(f"""with p as (select {_PAPERS} from documents), t as (select *, coalesce(case when length(ar5iv) > 1000 then ar5iv end, case when length(other) > 1000 then other end) as page from p)
select source_id, concat_ws({NL} || {NL}, '## ArXiv HTML version' || {NL} || {NL} || page, '## ArXiv PDF version' || {NL} || {NL} || nullif(pdf_text, '')) as text from t""")
def arxiv_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version in HTML that is long enough, and the PDF; either may be missing."""
    p = table(spark, sf_dir, "documents").selectExpr(f"inline(array(struct({_PAPERS})))")
    return p.select("source_id", S.paper_text(F.col("ar5iv"), F.col("other"), pdf=F.col("pdf_text")).alias("text"))


@query("""with p as (select doc_id as source_id, k as page, case when (doc_id + k) % 4 = 0 then null else substring(text, k * 100, 100) end as text from documents, generate_series(1, 3) g(k) where k <= 1 + doc_id % 3)
select source_id, string_agg('--- PAGE ' || page || '/' || n || ' ---' || chr(10) || coalesce(text, ''), chr(10) order by page) as text from (select *, count(*) over (partition by source_id) as n from p) group by source_id""")
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").selectExpr("doc_id", "explode(sequence(1, cast(1 + doc_id % 3 as int))) as page", "text")
    return S.pdf_pages_text(pages.selectExpr("doc_id as source_id", "page", "case when (doc_id + page) % 4 = 0 then null else substring(text, page * 100, 100) end as text"))


_NAMED = "page_id as source_id, case when page_id % 3 = 0 then 'pdf' else 'text' end as kind, case cast(page_id % 4 as int) when 0 then url when 1 then url || '/notes v1.txt' when 2 then url || '/a.b.pdf' else url || '/' end as url, 'x' as text"
_SLUG = lambda c: f"trim(regexp_replace(regexp_replace({c}, 'https?://', ''), '[^a-zA-Z0-9._-]+', '_', 'g'), '_')[:80]"


@query(f"""with d as (select {_NAMED} from pages), n as (select *, regexp_extract(url, '[^/]*$') as name from d)
select source_id, kind, case when kind = 'pdf' then 'document.txt' when name = '' then 'page.txt' else name end as rel,
 {_SLUG("case when kind = 'pdf' then case when strpos(name[2:], '.') > 0 then regexp_replace(name, '[.][^.]*$', '') else name end else url end")} as skill_basename from n""")
def text_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_bundles(table(spark, sf_dir, "pages").selectExpr(f"inline(array(struct({_NAMED})))")).select("source_id", "kind", "rel", "skill_basename")


@query(f"""with m as (select doc_id as source_id, 'https://m/' || doc_id as url, 'list ' || lang as text from documents), e as (select doc_id as source_id, k as place, 'https://e/' || k as url, case when (doc_id + k) % 3 = 0 or doc_id % 5 = 0 then null else substring(text, k, 50) end as markdown from documents, generate_series(1, 3) g(k)),
b as (select source_id, string_agg({NL} || {NL} || '===== MANIFEST ENTRY ' || place || '/3 — ' || url || ' =====' || {NL} || {NL} || markdown, '' order by place) as body from e where markdown is not null group by 1)
select source_id, '# llms.txt manifest: ' || url || {NL} || {NL} || text || {NL} || {NL} || coalesce(body, '') as text from m left join b using (source_id)""")
def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    m = docs.selectExpr("doc_id as source_id", "'https://m/' || doc_id as url", "'list ' || lang as text")
    e = docs.selectExpr("doc_id", "explode(sequence(1, 3)) as place", "text").selectExpr("doc_id as source_id", "place", "'https://e/' || place as url", "case when (doc_id + place) % 3 = 0 or doc_id % 5 = 0 then null else substring(text, place, 50) end as markdown")
    return B.manifest_bundles(m, e)


@query("""with r as (select o_orderkey as source_id, 'Own' || o_custkey % 9 as owner, case when o_orderkey % 2 = 0 then 'Repo' else 'repo' end || o_orderkey % 11 as repo, case when o_orderkey % 3 = 0 then 'main' end as ref from orders)
select lower(owner) as owner, lower(repo) as repo, coalesce(ref, '') as ref, min(source_id) as source_id from r group by 1, 2, 3""")
def repo_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository and ref is fetched for one source, whatever the case of its name."""
    return S.repositories(table(spark, sf_dir, "orders").selectExpr("o_orderkey as source_id", "'Own' || o_custkey % 9 as owner", "case when o_orderkey % 2 = 0 then 'Repo' else 'repo' end || o_orderkey % 11 as repo", "case when o_orderkey % 3 = 0 then 'main' end as ref"))


@query("""with o as (select 'https://github.com/o' || o_custkey % 20 as raw, o_custkey % 20 as source_id, 'r' || o_orderkey as repo, 1 as page, o_orderkey as pos, o_orderstatus = 'F' as gone from orders)
select source_id, raw || '#' || repo as raw, 'https://github.com/o' || source_id || '/' || repo as url from (select *, row_number() over (partition by source_id order by pos) as k from o where not gone) where k <= 25""")
def org_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations become sources of their own for each repository."""
    orders = table(spark, sf_dir, "orders")
    routed = route(orders.selectExpr("o_custkey % 20 as source_id", "'https://github.com/o' || o_custkey % 20 as raw").distinct())
    listing = orders.selectExpr("'o' || o_custkey % 20 as owner", "1 as page", "o_orderkey as pos", "'r' || o_orderkey as name", "o_orderstatus = 'F' as fork", "false as archived")
    return D.org_sources(routed, listing).select("source_id", "raw", "url")


_KINDS = "doc_id as source_id, case cast(doc_id % 8 as int) when 0 then 'https://t.org/n' || doc_id || '.txt' when 1 then 'https://p.org/a' || doc_id || '.pdf' when 2 then '2101.' || lpad(cast(doc_id % 100000 as string), 5, '0') when 3 then 'https://m' || doc_id || '.org/llms.txt' when 4 then 'https://w' || doc_id || '.org/x' when 5 then 'https://github.com/o/r' || doc_id when 6 then 'https://github.com/o' || doc_id else 'no source ' || doc_id end as raw"


@query(f"""with s as (select {_KINDS}, doc_id, coalesce(text, '') as t from documents), k as (select *, case doc_id % 8 when 0 then 'text' when 1 then 'pdf' when 2 then 'arxiv' when 3 then 'llms_manifest' when 4 then 'web' when 5 then 'github_repo' when 6 then 'github_org' else 'unknown' end as kind,
 case doc_id % 8 when 2 then 'https://arxiv.org/abs/' || raw when 7 then 'https://' || raw else raw end as url from s)
select source_id, kind, url, case kind when 'text' then {_SLUG("url")} when 'pdf' then 'a' || doc_id when 'arxiv' then 'arxiv_' || raw when 'llms_manifest' then {_SLUG("url")} when 'web' then {_SLUG("url")} when 'github_repo' then 'o_r' || doc_id end as skill_basename,
 case kind when 'text' then t when 'pdf' then '--- PAGE 1/2 ---' || {NL} || t[:100] || {NL} || '--- PAGE 2/2 ---' || {NL} || t[101:] when 'arxiv' then case when length(t) > 1000 then '## ArXiv HTML version' || {NL} || {NL} || t || {NL} || {NL} else '' end || '## ArXiv PDF version' || {NL} || {NL} || 'P' || doc_id
  when 'llms_manifest' then '# llms.txt manifest: ' || url || {NL} || {NL} || 'M' || {NL} || {NL} || {NL} || {NL} || '===== MANIFEST ENTRY 1/1 — https://e =====' || {NL} || {NL} || t
  when 'web' then t
  when 'github_repo' then '# Repository: o/r' || doc_id || {NL} || 'URL: ' || url || {NL} || 'Files: 1 text, 0 binary/excluded' || {NL} || {NL} || '## Directory tree' || {NL} || '```' || {NL} || 'src/' || {NL} || '  a.py  (100.0 B)' || {NL} || '```' || {NL} || {NL} || '## Extra context' || {NL} || {NL} || 'E' || {NL} || {NL} || '## File contents (priority-ordered)' || {NL} || {NL} || '### `src/a.py`' || {NL} || {NL} || '```py' || {NL} || t || {NL} || '```' || {NL} end as text,
 case when kind in ('github_org', 'unknown') then 'Cannot download kind=' || kind end as error from k""")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source of one of eight kinds, routed, read and bundled."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    routed = route(docs.selectExpr(f"inline(array(struct({_KINDS})))"))
    of = lambda k, *c: docs.where(F.col("doc_id") % 8 == k).selectExpr("doc_id as source_id", *c)
    return D.download(
        routed,
        files=of(5, "'src/a.py' as rel", "t as text", "100L as bytes", "false as is_binary"),
        extra=of(5, "'E' as extra_text"),
        pages=of(4, "1 as place", "'u' as url", "t as markdown"),
        papers=of(2, "t as html", "'P' || doc_id as pdf_text"),
        pdf_pages=of(1, "inline(array(struct(1 as page, substring(t, 1, 100) as text), struct(2 as page, substring(t, 101, length(t)) as text)))"),
        manifests=of(3, "'M' as text"),
        entries=of(3, "1 as place", "'https://e' as url", "t as markdown"),
        texts=of(0, "t as text"),
    )


_BYTES = "case cast(doc_id % 4 as int) when 0 then concat(X'4100', encode(coalesce(text, ''), 'utf-8')) when 1 then concat(encode('caf', 'utf-8'), X'ff', encode(lang, 'utf-8')) else encode(coalesce(text, ''), 'utf-8') end"


@query("""select doc_id as source_id, 'd/f.txt' as rel, doc_id % 4 = 0 as is_binary, case doc_id % 4 when 0 then null when 1 then 'caf' || chr(65533) || lang else coalesce(text, '') end as text from documents""")
def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero byte makes a file binary, bad UTF-8 is replaced."""
    return S.walk(table(spark, sf_dir, "documents").selectExpr("doc_id as source_id", "'d/f.txt' as rel", "cast(1 as long) as bytes", f"{_BYTES} as content")).select("source_id", "rel", "is_binary", "text")


@query(f"""select page_id, case when ends_with(u, '.txt') or ends_with(u, '.md') then 'text' else 'headless' end as method, ({_ANY(f"lower({_PATH.replace('url', 'u')})", T.DOCS_PATHS)} or {_ANY(_HOST.replace('url', 'u'), T.DOCS_HOSTS)}) as crawls, false as crawls_one
 from (select page_id, case cast(page_id % 4 as int) when 0 then url || '/docs/a' when 1 then url || '/x.md' when 2 then 'https://docs.a.org/' || page_id else url end as u from pages)""")
def fetch_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way each page would be read, and whether by a crawl of 25 pages, and of one."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "case cast(page_id % 4 as int) when 0 then url || '/docs/a' when 1 then url || '/x.md' when 2 then 'https://docs.a.org/' || page_id else url end as u")
    return rows.select("page_id", S.fetch_method(F.col("u")).alias("method"), S.reads_by_crawl(F.col("u")).alias("crawls"), S.reads_by_crawl(F.col("u"), 1).alias("crawls_one"))


@query("""select doc_id as source_id, unnest(['arxiv_html.md', 'arxiv_pdf.txt']) as rel, unnest([text, 'p' || lang]) as content from documents""")
def paper_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.paper_files(table(spark, sf_dir, "documents").selectExpr("doc_id as source_id", "text as html", "'p' || lang as pdf_text"))


# ---------------------------------------------------------------- lines, claims, verification


@query(f"with {LINES_SQL} select source_id, line_no, line, section, in_yaml, is_header, is_skipped from lines")
def skill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.skill_lines(skills(spark, sf_dir), "source_id")


@query(f"with {CLAIMS_SQL} select * from claims")
def claims_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claims(C.skill_lines(skills(spark, sf_dir), "source_id"), "source_id")


@query(f"with {CLAIMS_SQL} select ctype, count(*)::bigint as n, count(distinct norm_value)::bigint as n_values from claims group by ctype")
def claims_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_extract(spark, sf_dir).groupBy("ctype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("norm_value").alias("n_values"))


def _verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = C.skill_lines(skills(spark, sf_dir), "source_id")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"))
    return lines, V.verify_claims(C.claims(lines, "source_id"), V.fold_sources(sources), "source_id")


@query(f"with {VERIFIED_SQL} select source_id, line_no, claim_seq, ctype, value, verified from verified")
def claims_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)[1].select("source_id", "line_no", "claim_seq", "ctype", "value", "verified")


@query(f"""with {VERIFIED_SQL}, bad as (select source_id, line_no, count(*)::bigint as claims_total, list(ctype || ':' || value order by claim_seq) filter (where not verified) as claims_unverified from verified group by all)
select source_id, line_no, line, section, claims_total, claims_unverified from bad join lines using (source_id, line_no) where len(claims_unverified) > 0""")
def line_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.line_checks(*_verified(spark, sf_dir), "source_id")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.section_stats(*_verified(spark, sf_dir), "source_id")


@query(f"with {SECTIONS_SQL} select * from sections")
def section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


@query(f"""with {SECTIONS_SQL}, n as (select source_id, count(*) as total_lines_checked from lines group by 1),
s as (select source_id, sum(flagged_lines)::bigint as lines_flagged, sum(claims_total)::bigint as claims_total, sum(claims_unverified)::bigint as claims_unverified,
 list(section order by pct_verified, first_line) as worst_first from sections group by 1)
select source_id, total_lines_checked, lines_flagged, claims_total, claims_unverified, {PCT("claims_unverified", "claims_total")} as pct_verified, worst_first from n join s using (source_id)""")
def skill_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, verified = _verified(spark, sf_dir)
    s = V.summaries(lines, V.section_stats(lines, verified, "source_id"), "source_id")
    return s.select("source_id", "total_lines_checked", "lines_flagged", "claims_total", "claims_unverified", "pct_verified", F.transform("per_section", lambda x: x["section"]).alias("worst_first"))


@query(f"""with {SECTIONS_SQL}, w as (select source_id, {PCT("sum(claims_unverified)", "sum(claims_total)")} as whole from sections group by 1),
r as (select s.*, row_number() over (partition by source_id order by pct_verified, first_line) as k from sections s join w using (source_id) where claims_total >= 3 and pct_verified < whole)
select source_id, section, pct_verified from r where k = 1""")
def worst_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.worst_section(_sections(spark, sf_dir), "source_id")


_RISKY = sql_str("(?i)" + "|".join(T.DANGEROUS_SECTIONS))


@query(f"with {SECTIONS_SQL} select source_id, section, pct_verified, claims_total, claims_unverified from sections where claims_total >= 3 and pct_verified < 92 and (regexp_matches(section, {_RISKY}) or pct_verified < 87)")
def dangerous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dangerous_sections(_sections(spark, sf_dir)).select("source_id", "section", "pct_verified", "claims_total", "claims_unverified")


_KIND = "case cast(source_id % 5 as int) when 0 then 'github_repo' when 1 then 'web' when 2 then 'github_org' when 3 then 'arxiv' else 'unknown' end"


@query(f"""with {SECTIONS_SQL}, d as (select source_id, count(*) filter (where claims_total >= 3 and pct_verified < 60 and (regexp_matches(section, {_RISKY}) or pct_verified < 55)) > 0 as has from sections group by 1), k as (select *, {_KIND} as kind from d)
select source_id, kind, kind in ('github_repo', 'web', 'arxiv') and (has or kind = 'github_repo') as triggered from k""")
def guard_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    risky = V.dangerous_sections(s, 60.0).select("source_id", F.lit(True).alias("has")).distinct()
    rows = s.select("source_id").distinct().join(risky, "source_id", "left").withColumn("kind", F.expr(_KIND))
    return rows.select("source_id", "kind", V.guard_trigger(F.col("kind"), F.coalesce("has", F.lit(False))).alias("triggered"))


@query(f"""with {VERIFIED_SQL}, bad as (select source_id, line_no, list(ctype || ':' || value order by claim_seq) filter (where not verified) as u from verified group by all),
f as (select *, row_number() over (partition by source_id order by line_no) as k from bad join lines using (source_id, line_no) where len(u) > 0)
select source_id, string_agg('- Line ' || line_no || ': ' || line[:160] || chr(10) || '  Unverified claims: ' || array_to_string(u[:6], ', ') || case when len(u) > 6 then ', +' || (len(u) - 6) || ' more' else '' end, chr(10) order by k) as feedback from f where k <= 40 group by source_id""")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.feedback_block(V.line_checks(*_verified(spark, sf_dir), "source_id"), "source_id")


@query("""with r as (select conv_id, turn::int as round, case when conv_id % 5 = 0 then 0.0::double else ((length(coalesce(text, '')) % 7) * 10)::double end as pct from conversations),
g as (select conv_id, max(pct) as top, max(round) as last, arg_max(round, (pct, -round)) as best from r group by conv_id)
select conv_id, case when top > 0 then best else last end as best_round, top as pct_verified from g""")
def best_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = F.when(F.col("conv_id") % 5 == 0, 0.0).otherwise(((F.length(F.coalesce("text", F.lit(""))) % 7) * 10).cast("double"))
    return V.best_round(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("round"), pct.alias("pct_verified")), "conv_id")


_STATUS = "case cast(turn % 5 as int) when 0 then 'ok' when 1 then 'raw_only' when 2 then 'error' when 3 then 'skipped' else 'empty_llm' end"


@query(f"select count(*) filter (where s = 'ok')::bigint as ok, count(*) filter (where s = 'raw_only')::bigint as raw_only, count(*) filter (where s = 'error')::bigint as error from (select {_STATUS} as s from conversations)")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.status_rollup(table(spark, sf_dir, "conversations").selectExpr(f"{_STATUS} as status"))


# ---------------------------------------------------------------- reports


@query(f"""with {VERIFIED_SQL}, bad as (select source_id, line_no, list(value order by claim_seq) filter (where not verified) as u from verified group by all)
select source_id, string_agg(line || case when len(u) > 0 then '  <!-- ⚠ UNVERIFIED: ' || array_to_string(u[:4], ', ') || case when len(u) > 4 then ', +' || (len(u) - 4) || ' more' else '' end || ' -->' else '' end, chr(10) order by line_no) || chr(10) as annotated
from lines left join bad using (source_id, line_no) group by source_id""")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, verified = _verified(spark, sf_dir)
    return R.annotate(lines, V.line_checks(lines, verified, "source_id"), "source_id")


_HALF_FRONT = "case when source_id % 4 = 0 then substring(skill_text, strpos(skill_text, '# Title'), length(skill_text)) when source_id % 4 = 1 then skill_text || chr(10) || '<!-- VERBATIM-DIRECTIVE-V1 -->' else skill_text end"


@query(f"""with {SECTIONS_SQL}, d as (select source_id, list('_' || section || '_ (' || printf('%.1f', pct_verified) || '%)' order by pct_verified, first_line) as l from sections
 where claims_total >= 3 and pct_verified < 92 and (regexp_matches(section, {_RISKY}) or pct_verified < 87) group by 1),
t as (select source_id, {_HALF_FRONT} as text, case when l is null then '(precautionary — no specific sections flagged)' else array_to_string(l[:5], ', ') || case when len(l) > 5 then ', +' || (len(l) - 5) || ' more' else '' end end as names from skills left join d using (source_id)),
f as (select *, case when starts_with(text, '---') then array_to_string(string_split(text, {NL})[:4], {NL}) || {NL} else '' end as front from t)
select source_id, names, case when contains(text, '{T.DIRECTIVE_MARKER}') then text else front || case when front = '' then '' else {NL} end || '{T.DIRECTIVE_MARKER}' || {NL} || '> **⚠ Check identifiers before writing code**' || {NL} || '>' || {NL}
 || '> Parts of this document could not be verified against its source: ' || names || {NL} || '>' || {NL} || '> Take names, parameters, types, constants, configuration keys and paths from `VERBATIM_REFERENCE.md`, which is copied' || {NL}
 || '> from the source. What stands only here is unverified.' || {NL} || {NL} || text[length(front) + 1:] end as once from f""")
def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notice behind the front matter, at the top without one, and not again where its marker is; injected twice, it stands once."""
    d = V.dangerous_sections(_sections(spark, sf_dir)).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pct_verified", "first_line", "section"))).alias("d"))
    rows = skills(spark, sf_dir).join(d, "source_id", "left").withColumn("d", F.coalesce("d", F.array().cast("array<struct<pct_verified:double,first_line:int,section:string>>")))
    rows = rows.withColumn("text", F.expr(_HALF_FRONT.replace("strpos(skill_text, '# Title')", "locate('# Title', skill_text)")))
    return rows.select("source_id", R.flagged_names(F.col("d")).alias("names"), R.inject_directive(R.inject_directive(F.col("text"), F.col("d")), F.col("d")).alias("once"))


@query("""with s as (select page_id as source_id, 'name' || (page_id % 9) as name, url from pages), o as (select *, first_value(url) over (partition by name order by source_id) as own from s)
select source_id, case when url = own or url = '' then name else name || '__' || md5(url)[:6] end as skill_key from o""")
def skill_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), F.concat(F.lit("name"), (F.col("page_id") % 9).cast("string")).alias("name"), "url")
    return R.skill_keys(s).select("source_id", "skill_key")


@query(f"""with {SECTIONS_SQL}, n as (select source_id, count(*) as total_lines_checked from lines group by 1),
t as (select source_id, sum(flagged_lines)::bigint as flagged, sum(claims_total)::bigint as total, sum(claims_unverified)::bigint as bad, {PCT("sum(claims_unverified)", "sum(claims_total)")} as pct,
 coalesce(string_agg('| ' || section || ' | ' || claims_total || ' | ' || claims_unverified || ' | ' || printf('%.1f', pct_verified) || '% | ' || flagged_lines || '/' || lines || ' |', {NL} order by pct_verified, first_line) filter (where claims_total > 0), '') as rows from sections group by 1),
bad as (select source_id, line_no, count(*) as of_all, list(ctype || ':' || value order by claim_seq) filter (where not verified) as u from verified group by all),
f as (select source_id, string_agg('### Line ' || line_no || ' — section: _' || section || '_' || {NL} || {NL} || '> ' || line[:300] || {NL} || {NL} || 'Unverified (' || len(u) || ' of ' || of_all || '):' || {NL}
  || array_to_string(list_transform(u, lambda x: '- `' || x || '`'), {NL}) || {NL}, {NL} order by line_no) as flagged_lines from bad join lines using (source_id, line_no) where len(u) > 0 group by 1)
select source_id, '# Verification report' || {NL} || {NL} || '## Summary' || {NL} || '- Total claims checked: **' || total || '**' || {NL} || '- Unverified claims: **' || bad || '**' || {NL} || '- Lines flagged: **' || flagged || '** of ' || total_lines_checked || {NL}
 || '- Overall verified: **' || printf('%.1f', pct) || '%**' || {NL} || {NL} || '## Per-section breakdown' || {NL} || {NL} || '| Section | Claims | Unverified | % verified | Lines flagged |' || {NL} || '| --- | ---: | ---: | ---: | ---: |' || {NL} || rows || {NL} || {NL}
 || coalesce('## Flagged lines' || {NL} || {NL} || flagged_lines, 'No unverified claims found.') as report from n join t using (source_id) left join f using (source_id)""")
def verification_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, verified = _verified(spark, sf_dir)
    s = V.summaries(lines, V.section_stats(lines, verified, "source_id"), "source_id")
    return R.verification_report(s, V.line_checks(lines, verified, "source_id"), "source_id")


@query("""select '{"conv_id":' || conv_id || ',"status":"' || """ + _STATUS + """ || '","claims_total":' || turn || case when turn % 2 = 0 then ',"url":"https://x/' || conv_id || '"' else '' end || '}' as json from conversations""")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", f"{_STATUS} as status", "turn as claims_total", "case when turn % 2 = 0 then 'https://x/' || conv_id end as url")
    return R.result_records(rows)


_LONGER = "skill_text || repeat(chr(10) || 'more of it', cast(source_id % 6 as int) * 100)"


@query(f"""with {SKILLS_SQL}, n as (select source_id, len(string_split({_LONGER}, {NL}))::bigint as n_lines from skills)
select *, case when n_lines < 250 then 'below' when n_lines < 400 then 'minimum' when n_lines < 500 then 'good' else 'excellent' end as grade from n""")
def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = skills(spark, sf_dir).selectExpr("source_id", f"{_LONGER} as skill_text")
    return R.quality_grade(C.skill_lines(longer, "source_id"), "source_id")


_RECORDS = f"conv_id * 100 + turn + 1 as place, 'https://x/' || conv_id as raw, case when turn % 7 = 6 then null else 'github_repo' end as kind, {_STATUS} as status, case when turn % 3 = 0 then null when turn % 3 = 1 then -1.0 else 52.5 + turn end as pct_verified, 'E: ' || repeat(role, 20) as error"


@query(f"""with r as (select {_RECORDS} from conversations)
select 0::bigint as place, 'DONE: ' || count(*) filter (where status = 'ok') || ' ok, ' || count(*) filter (where status = 'raw_only') || ' raw-only, ' || count(*) filter (where status = 'error') || ' errored' as line from r
union all select place, '  ' || case when status = 'ok' then '✓' when status = 'raw_only' then '○' when status = 'skipped' then '⏭' else '✗' end || ' [' || rpad(coalesce(kind, '?'), 14, ' ') || '] ' || raw
 || case when pct_verified >= 0 then '  (' || printf('%.1f', pct_verified) || '% verified)' else '' end || case when status = 'error' then '  — ' || error[:60] else '' end from r""")
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.console_summary(table(spark, sf_dir, "conversations").selectExpr(f"inline(array(struct({_RECORDS})))"))


_STORED = "'n' || cast(page_id % 50 as string) as skill_key, 'https://s/' || cast(page_id % 3 as string) as url, 'old ' || cast(page_id as string) as text"
_SAVED = "'n' || cast(page_id as string) as skill_key, case when page_id % 5 = 0 then '' else 'https://s/1' end as url, 'new ' || cast(page_id as string) as text"


@query(f"""with stored as (select {_STORED} from pages where page_id in (select max(page_id) from pages group by page_id % 50)), saved as (select {_SAVED} from pages),
named as (select case when s.url <> '' and o.url <> '' and o.url <> s.url then s.skill_key || '__' || md5(s.url)[:6] else s.skill_key end as skill_key, s.url, s.text from saved s left join stored o using (skill_key))
select skill_key, 'SKILL.md' as rel, text as content from named union all select skill_key, '.source_url', url from named where url <> ''
union all select skill_key, 'SKILL_prev_120000.md', o.text from named join stored o using (skill_key)""")
def skill_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saving next to what is stored: names that other sources hold, and backups."""
    pages = table(spark, sf_dir, "pages")
    last = pages.groupBy((F.col("page_id") % 50).alias("k")).agg(F.max("page_id").alias("page_id")).select("page_id")
    return R.skill_files(pages.selectExpr(f"inline(array(struct({_SAVED})))"), pages.join(last, "page_id").selectExpr(f"inline(array(struct({_STORED})))"), "120000")


# ---------------------------------------------------------------- verbatim extraction


def _docs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir).select("source_id", F.lit("a/page.md").alias("rel"), F.col("skill_text").alias("content"))


_FENCED = " || chr(10) || ".join(["'# H ' || source", "'intro'", "'```py'", WORD(1), "'```'", "case when doc_id % 3 = 0 then '## Second' else 'text' end", "'```'", "'# inside'", WORD(2), "'```' || case when doc_id % 5 = 0 then chr(10) || '~~~' || chr(10) || '```sh' || chr(10) || 'open ' || lang else '' end"])


@query(f"""select doc_id as source_id, 'b/c.md' as rel, 2 as block_count, '**# H ' || source || '**' || {NL} || {NL} || '```py' || {NL} || {WORD(1)} || {NL} || '```' || {NL} || {NL}
 || case when doc_id % 3 = 0 then '**## Second**' || {NL} || {NL} else '' end || '```' || {NL} || '# inside' || {NL} || {WORD(2)} || {NL} || '```' || {NL}
 || case when doc_id % 5 = 0 then {NL} || '**# inside**' || {NL} || {NL} || '```sh' || {NL} || 'open ' || lang else '' end as blocks from (select doc_id, coalesce(text, '') as text, lang, source from documents)""")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that change, that stay, and that stand inside a block; a fence that is never closed."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return E.code_blocks(docs.selectExpr("doc_id as source_id", "'b/c.md' as rel", f"{_FENCED} as content"))


@query(f"""with {SKILLS_SQL}, v as (select source_id, unnest(regexp_extract_all(skill_text, {sql_str(T.INLINE_IDENTIFIER)}, 1)) as v from skills)
select source_id, list(distinct v order by v)[:300] as identifiers from v where lower(v) not in ('yes', 'no', 'true', 'false') group by source_id""")
def inline_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.inline_identifiers(_docs_files(spark, sf_dir))


@query("""select doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,6}\\s+.*$', '', 'g'), '(?m)^```.*$', '', 'g'), '_\\([^)]+\\)_', '', 'g'), '\\s+', '', 'g')) < 1500 as sparse
from (select doc_id, '# h ' || source || chr(10) || '```py' || chr(10) || text || chr(10) || '_(no code)_' as t from documents where text is not null)""")
def sparse_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "'# h ' || source || chr(10) || '```py' || chr(10) || text || chr(10) || '_(no code)_' as t")
    return t.select("doc_id", X.extraction_sparse(F.col("t")).alias("sparse"))


@query(f"""with f as (select page_id % 30 as source_id, 'p' || (page_id // 2) || case when page_id % 3 = 0 then '.md' else '.html' end as rel, {_STRIPPED} as content, page_id % 3 <> 0 as page from pages),
m as (select source_id, replace(rel, '.md', '') as stem from f where not page)
select source_id, page::int as kind, rel, content from f where content <> '' and (not page or not exists (select 1 from m where m.source_id = f.source_id and m.stem = replace(f.rel, '.html', '')))""")
def docs_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = "'p' || cast(floor(page_id / 2) as bigint) || case when page_id % 3 = 0 then '.md' else '.html' end"
    return E.page_fallback(table(spark, sf_dir, "pages").selectExpr("page_id % 30 as source_id", f"{rel} as rel", "html as content"))


_CODE_REL = "case cast(doc_id % 6 as int) when 0 then 'src/main.py' when 1 then 'package.json' when 2 then 'lib/a' || cast(doc_id as string) || '.rb' when 3 then 'main.go' when 4 then 'index.ts' else 'tests/test_a.py' end"
_CODE = "case cast(doc_id % 6 as int) when 2 then 'class A' || chr(10) || '  def b' || chr(10) || substring(text, 1, 50) || chr(10) || 'module C' else text end"


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.selectExpr("doc_id as source_id", f"{_CODE_REL} as rel", f"{_CODE} as content")


@query(f"""with f as (select doc_id as source_id, {_CODE_REL} as rel, text as content from (select doc_id, coalesce(text, '') as text from documents))
select source_id, list_position({sql_list(T.ENTRY_POINTS)}, rel)::int as place, rel, content from f where list_contains({sql_list(T.ENTRY_POINTS)}, rel) and strlen(content) <= 80000
union all select source_id, list_position({sql_list(T.MANIFESTS)}, rel)::int, rel, content[:8000] from f where list_contains({sql_list(T.MANIFESTS)}, rel)""")
def entry_points_and_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _code_files(spark, sf_dir)
    return E.entry_points(files).unionByName(E.manifests(files))


@query(f"""with f as (select doc_id as source_id, {_CODE_REL} as rel, string_split({_CODE}, chr(10)) as l from (select doc_id, coalesce(text, '') as text from documents) where doc_id % 6 = 2),
x as (select source_id, rel, unnest(l) as line, generate_subscripts(l, 1) as pos from f), k as (select *, row_number() over (partition by source_id, rel order by pos) as n from x where regexp_matches(ltrim(line), '^(class |module |def )'))
select source_id, rel, n::int as n, line from k where n <= 200""")
def ruby_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ruby_lines(_code_files(spark, sf_dir)).select("source_id", "rel", "n", "line")


_PYTHON = """'@dec(' || {w1} || ')' || chr(10) || 'def f(a,' || chr(10) || '      b):' || chr(10) || case cast(doc_id % 5 as int) when 0 then '    \"\"\"one ' || {w2} || '\"\"\"' || chr(10) when 1 then '    \"\"\"more' || chr(10) || '    def inside():' || chr(10) || '    end\"\"\"' || chr(10)
 when 2 then '    #' || chr(10) when 3 then '    \"\"\"' || chr(10) || 'class Never:' || chr(10) else '' end || '    return 1' || chr(10) || 'class A(B):' || chr(10) || '  x = 1' || chr(10) || '  async def g(self): pass' || chr(10) || repeat('def h(): return 2' || chr(10), cast(doc_id % 150 as int)) || 'def last('"""
_BRACES = """'{start} f() {{' || chr(10) || '  if (x) {{ ' || {w1} || ' }}' || chr(10) || '{start} nested() {{ {{' || chr(10) || repeat('  y;' || chr(10), cast(doc_id % 70 as int)) || '}} }}' || chr(10) || '}}' || chr(10) || 'other {{' || chr(10) || '}}' || chr(10) || '{start} q = ' || {w2} || chr(10)
 || repeat('{start} z' || chr(10), cast(doc_id % 110 as int)) || '{start} open {{' || chr(10) || 'tail }} }}' || chr(10) || 'end'"""
_FIRST, _SECOND = "regexp_extract(text, '([a-z]+)', 1)", "regexp_extract(text, '[a-z]+ ([a-z]+)', 1)"
_SOURCE = "case cast(doc_id % 3 as int) when 0 then " + _PYTHON.format(w1=_FIRST, w2=_SECOND) + " when 1 then " + _BRACES.format(start="export", w1=_FIRST, w2=_SECOND) + " else " + _BRACES.format(start="pub fn", w1=_FIRST, w2=_SECOND) + " end"
_SOURCE_REL = "'a/f' || cast(doc_id as string) || case cast(doc_id % 3 as int) when 0 then '.py' when 1 then '.ts' else '.rs' end"


@query(f"""with recursive f as (select doc_id as source_id, {_SOURCE_REL} as rel, case doc_id % 3 when 0 then 'python' when 1 then 'typescript' else 'rust' end as lang, string_split({_SOURCE}, {NL}) as l from (select doc_id, coalesce(text, '') as text from documents)),
m as (select *, len(l) as n, list_transform(l, lambda x: case lang when 'python' then regexp_matches(ltrim(x), '^(def |async def |class |@)') when 'typescript' then regexp_matches(x, '^\\s*(export\\s|declare\\s)') else regexp_matches(x, '^\\s*pub\\s+(fn|struct|enum|trait|mod|type|const|static)\\s') end) as starts,
  list_transform(l, lambda x: (length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', '')))) as delta from f),
-- mode 0: between blocks; 1: in a block or head; 2: at the line behind a head; 3: in a docstring
walk as (select *, 1 as i, 0 as mode, 0 as depth, 0 as since, []::varchar[] as shown from m
  union all
  select source_id, rel, lang, l, n, starts, delta, i + 1, case
      when lang <> 'python' then case when now and level <> 0 and i < n then 1 else 0 end
      when mode = 3 then case when contains(x, '\"\"\"') or i = n then 0 else 3 end
      when mode = 2 then case when (trim(x) <> '\"\"\"' and ends_with(trim(x), '\"\"\"')) or i = n then 0 else 3 end
      when now then case when not ends_with(rtrim(x), ':') and i < n then 1 when i < n and starts_with(trim(l[i + 1]), '\"\"\"') then 2 else 0 end else 0 end,
    case when now then level else 0 end, case when mode = 0 then i else since end,
    case when lang <> 'python' then case when now and (level = 0 or i = n) then shown || (case when i - first + 1 > 50 then l[first:first + 4] || ['    // ... body elided (long) ...'] else l[first:i] end) || [''] else shown end
      when mode >= 2 then shown || [x] || (case when i = n or (mode = 3 and contains(x, '\"\"\"')) or (mode = 2 and trim(x) <> '\"\"\"' and ends_with(trim(x), '\"\"\"')) then [''] else [] end)
      when now then shown || [x] || (case when i = n or (ends_with(rtrim(x), ':') and not starts_with(trim(l[i + 1]), '\"\"\"')) then [''] else [] end) else shown end
  from (select *, l[i] as x, mode = 1 or (mode = 0 and starts[i] and len(shown) < 200) as now, case when mode = 0 then 0 else depth end + delta[i] as level, case when mode = 0 then i else since end as first from walk where i <= n))
select source_id, lang, rel, array_to_string(shown, {NL}) as content from walk where i = n + 1""")
def code_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorators, docstrings of four shapes, nesting, bodies that are long or never close, and more lines than are shown; the oracle walks line by line."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return E.signatures(docs.selectExpr("doc_id as source_id", f"{_SOURCE_REL} as rel", f"{_SOURCE} as content")).select("source_id", "lang", "rel", "content")


@query()
def verbatim_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _code_files(spark, sf_dir).unionByName(_docs_files(spark, sf_dir).where("source_id % 2 = 0"))
    sources = table(spark, sf_dir, "documents").selectExpr("doc_id as source_id", "case when doc_id % 2 = 0 then 'web' else 'github_repo' end as kind")
    return E.reference(sources, files, F.lit("(precautionary)")).select("source_id", "kind", "reference")


# ---------------------------------------------------------------- loop and streaming


@query()
def generate_and_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded loop with the stub generator over all documents."""
    bundles = table(spark, sf_dir, "documents").selectExpr("doc_id as source_id", "'web' as kind", "'https://x/' || doc_id as url", "coalesce(text, '') as text")
    return L.agentic_loop(bundles, L.stub_generator, cut)[0].select("source_id", "round", "pct_verified")


@query("""select date_trunc('hour', ts) as window_start, event_type, count(*)::bigint as n, sum(value) as total from events group by 1, 2""".replace("sum(value) as total", "round(sum(value), 2) as total"))
def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))
