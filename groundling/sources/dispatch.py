"""From routed sources to bundles: every kind by its own reader, all in one table.

What the network brings is given as tables by source: repository files, pages, papers, PDF pages, manifests and their
entries, plain texts.  Each kind is a join of its sources with its own tables, and the kinds are a union, so Spark plans
them side by side and a kind whose tables are not given costs nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import bundle as B
from . import readers as R

COLUMNS = ["source_id", "kind", "url", "skill_basename", "text", "error"]


def org_sources(routed: DataFrame, listing: DataFrame, max_repos: int = 25) -> DataFrame:
    """The repositories of organisation sources as sources: (source_id of the organisation, raw, kind, url, owner, repo)."""
    orgs = routed.where("kind = 'github_org'").select("source_id", "raw", "owner")
    repos = orgs.join(R.org_repos(listing, max_repos).withColumnRenamed("name", "repo"), "owner")
    url = F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo")
    return repos.select("source_id", F.concat("raw", F.lit("#"), "repo").alias("raw"), F.lit("github_repo").alias("kind"), url.alias("url"), "owner", "repo")


def download(
    routed: DataFrame,
    files: DataFrame | None = None,
    extra: DataFrame | None = None,
    pages: DataFrame | None = None,
    papers: DataFrame | None = None,
    pdf_pages: DataFrame | None = None,
    manifests: DataFrame | None = None,
    entries: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """One row per source of ``routed(source_id, kind, url, arxiv_id, owner, repo)``: source_id, kind, url, skill_basename, text, error.

    ``files(source_id, rel, text, bytes, is_binary)`` and ``extra(source_id, extra_text)`` are of repositories, ``pages
    (source_id, place, url, markdown)`` of the web, ``papers(source_id, html, pdf_text)``, ``pdf_pages(source_id, page, text)``,
    ``manifests(source_id, text)`` with ``entries(source_id, place, url, markdown)``, and ``texts(source_id, text)``.  A source of
    a kind that is not fetched as such, or of which nothing was fetched, has an error and no text; a web source without
    pages has an empty text.
    """
    made = []

    def add(rows: DataFrame, base, text):
        made.append(rows.select("source_id", "kind", "url", base.alias("skill_basename"), text.alias("text")))

    def of(*kinds: str) -> DataFrame:
        return routed.where(F.col("kind").isin(*kinds))

    if files is not None:
        trees = R.tree_listing(files.select("source_id", "rel", "bytes"), "source_id")
        repos = of(*T.REPO_EXTRACTED_KINDS).select("source_id", "kind", "owner", "repo", "url").join(trees, "source_id")
        repos = repos.join(extra.select("source_id", "extra_text"), "source_id", "left") if extra is not None else repos.withColumn("extra_text", F.lit(""))
        add(B.repo_bundles(repos, files), F.col("skill_basename"), F.col("text"))
    if pages is not None:
        found = B.web_bundles(pages).select("source_id", F.col("text").alias("t"))
        add(of("web").join(found, "source_id", "left"), X.slugify(F.col("url")), F.coalesce("t", F.lit("")))
    if papers is not None:
        p = papers.select("source_id", R.paper_text(F.col("html"), pdf=F.col("pdf_text")).alias("t"))
        add(of("arxiv").join(p, "source_id"), F.concat(F.lit("arxiv_"), F.replace(F.col("arxiv_id"), F.lit("/"), F.lit("_"))), F.col("t"))
    for kind, table in (("pdf", None if pdf_pages is None else R.pdf_pages_text(pdf_pages)), ("text", texts)):
        if table is not None:
            d = B.document_bundles(of(kind).select("source_id", "kind", "url").join(table.select("source_id", "text"), "source_id"))
            add(d, F.col("skill_basename"), F.col("text"))
    if manifests is not None:
        m = of("llms_manifest").select("source_id", "kind", "url").join(manifests.select("source_id", "text"), "source_id")
        none = routed.sparkSession.createDataFrame([], "source_id long, place int, url string, markdown string")
        b = B.manifest_bundles(m, entries if entries is not None else none).select("source_id", F.col("text").alias("t"))
        add(m.join(b, "source_id"), X.slugify(F.col("url")), F.col("t"))

    known = routed.select("source_id", "kind", "url")
    if not made:
        got = known.select("source_id", F.lit(None).cast("string").alias("skill_basename"), F.lit(None).cast("string").alias("text")).limit(0)
    else:
        got = reduce(DataFrame.unionByName, made).select("source_id", "skill_basename", "text")
    fetched = F.col("kind").isin(*T.REPO_EXTRACTED_KINDS, "web", "arxiv", "pdf", "text", "llms_manifest")
    error = F.when(F.col("text").isNotNull(), None).when(fetched, F.concat(F.lit("nothing fetched for kind="), "kind")).otherwise(F.concat(F.lit("Cannot download kind="), "kind"))
    return known.join(got, "source_id", "left").withColumn("error", error).select(*COLUMNS)
