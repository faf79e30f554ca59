"""Which kind of source a raw string is: an ordered chain of conditions, one Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import strip, with_scheme


def _first_segment(c: Column) -> Column:
    return F.substring_index(c, "/", 1)


def route(df: DataFrame, raw: str = "raw", local_pdf: Column | None = None) -> DataFrame:
    """``df`` with kind, url, arxiv_id, owner, repo, ref, path, pr and is_url of the column ``raw``.

    ``local_pdf``: whether the string names an existing file (only the caller can know); none does by default.
    Null counts as empty.
    """
    s = strip(F.coalesce(F.col(raw), F.lit("")))
    low, full = F.lower(s), with_scheme(s)
    git = lambda k: F.regexp_extract(full, T.GITHUB_URL, k)
    arxiv_url = F.regexp_extract(s, T.ARXIV_URL, 1)
    is_git, form, rest = full.rlike(T.GITHUB_URL), git(3), git(4)
    local = (local_pdf if local_pdf is not None else F.lit(False)) & low.endswith(".pdf")
    kind = (
        F.when((s == "") | s.startswith("#"), "skip")
        .when(local, "local_pdf")
        .when(s.rlike(T.ARXIV_ID), "arxiv_id")
        .when(s.contains("arxiv.org") & (arxiv_url != ""), "arxiv_url")
        .when(is_git & (git(2) == ""), "github_org")
        .when(is_git & form.isin("blob", "raw"), "github_blob")
        .when(is_git & (form == "pull"), "github_pr")
        .when(is_git, "github_repo")
        .when(low.endswith("llms.txt"), "llms_manifest")
        .when(s.endswith(".txt") | s.endswith(".md"), "text")
        .when(low.endswith(".pdf") & s.startswith("http"), "pdf")
        .when(s.startswith("http") | (s.rlike(T.DOMAIN_LIKE) & ~s.contains(" ")), "web")
        .otherwise("unknown")
    )
    arxiv = F.when(F.col("__kind") == "arxiv_id", F.substring_index(s, "v", 1)).when(F.col("__kind") == "arxiv_url", arxiv_url)
    home = F.concat(F.lit("https://github.com/"), git(1))
    k = F.col("__kind")
    on_git = k.startswith("github_")
    url = (
        F.when(k == "skip", "")
        .when(k == "local_pdf", s)
        .when(arxiv.isNotNull(), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
        .when(k == "github_org", home)
        .when(k == "github_pr", F.concat(home, F.lit("/"), git(2), F.lit("/pull/"), _first_segment(rest)))
        .when(on_git, F.concat(home, F.lit("/"), git(2)))
        .otherwise(full)
    )
    blob = k == "github_blob"
    return (
        df.withColumn("__kind", kind)
        .withColumns(
            {
                "url": url,
                "arxiv_id": arxiv,
                "owner": F.when(on_git, git(1)),
                "repo": F.when(on_git & (k != "github_org"), git(2)),
                "ref": F.when(blob | (form == "tree") & (k == "github_repo"), _first_segment(rest)),
                "path": F.when(blob, F.when(rest.contains("/"), F.regexp_replace(rest, "^[^/]*/", "")).otherwise("")),
                "pr": F.when(k == "github_pr", _first_segment(rest)),
                "is_url": k == "pdf",
            }
        )
        .withColumn("kind", F.when(k.startswith("arxiv"), "arxiv").when(k == "local_pdf", "pdf").otherwise(k))
        .drop("__kind")
    )


def read_list(spark, path: str) -> DataFrame:
    """A list of sources, one a line: (raw), without blank and comment lines."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("raw"))
    return rows.where((F.col("raw") != "") & ~F.col("raw").startswith("#"))


def routing_counts(routed: DataFrame) -> DataFrame:
    """Sources of each kind, most first, then by name."""
    return routed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def auth_needed(routed: DataFrame, has_token: bool = False) -> DataFrame:
    """One row: how many sources would need a token (none if there is one)."""
    return routed.agg(F.count_if(F.col("kind").isin(*T.AUTH_KINDS) & F.lit(not has_token)).alias("n"))


def single_source(github: str | None = None, arxiv: str | None = None, url: str | None = None, pdf: str | None = None) -> tuple[str | None, bool]:
    """(source, whether it is a PDF given as such): options in order of precedence."""
    for value in (github, arxiv, url):
        if value:
            return value, False
    return pdf, bool(pdf)
