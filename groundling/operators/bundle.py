"""Bundles: the text and the files of a source, assembled per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T
from ..functions import text as X

MAX_BINARIES = 200


def _listed(rows: DataFrame, order: str, text, sep: str, name: str) -> DataFrame:
    g = rows.select("source_id", order, text.alias("__t")).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(order, "__t"))).alias("l"))
    return g.select("source_id", F.array_join(F.transform("l", lambda x: x["__t"]), sep).alias(name))


def repo_bundles(repos: DataFrame, files: DataFrame) -> DataFrame:
    """``repos(source_id, owner, repo, url, tree, extra_text)`` with text, n_files, n_binaries and skill_basename.

    ``files(source_id, rel, text, bytes, is_binary)``: texts come in order of priority, at most 200 of the others are
    listed, in order of path.
    """
    texts = files.where("not is_binary").withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(X.file_priority(F.col("rel")), "rel")))
    ext = F.regexp_replace(X.suffix(F.col("rel")), r"^\.", "")
    shown = F.concat(F.lit("### `"), "rel", F.lit("`\n\n```"), ext, F.lit("\n"), "text", F.lit("\n```\n"))
    body = _listed(texts, "place", shown, "\n", "body")
    bins = files.where("is_binary").withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("rel")))
    inventory = _listed(bins.where(F.col("place") <= MAX_BINARIES), "place", F.concat(F.lit("- `"), "rel", F.lit("` ("), X.sizeof(F.col("bytes")), F.lit(")")), "\n", "inventory")
    counts = files.groupBy("source_id").agg(F.count_if(~F.col("is_binary")).alias("n_files"), F.count_if("is_binary").alias("n_binaries"))
    out = repos
    for part in (body, inventory, counts):
        out = out.join(part, "source_id", "left")
    out = out.withColumns({"n_files": F.coalesce("n_files", F.lit(0)).cast("long"), "n_binaries": F.coalesce("n_binaries", F.lit(0)).cast("long")})
    n = F.col("n_binaries")
    more = F.when(n > MAX_BINARIES, F.concat(F.lit("- … +"), (n - MAX_BINARIES).cast("string"), F.lit(" more")))
    extra = F.nullif(F.coalesce("extra_text", F.lit("")), F.lit(""))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Repository: "), "owner", F.lit("/"), "repo"),
        F.concat(F.lit("URL: "), "url"),
        F.concat(F.lit("Files: "), F.col("n_files").cast("string"), F.lit(" text, "), n.cast("string"), F.lit(" binary/excluded")),
        F.lit("\n## Directory tree\n```"), F.coalesce("tree", F.lit("")), F.lit("```"),
        F.when(n > 0, F.concat(F.lit("\n## Binary / excluded inventory\n"), "inventory")), more,
        F.when(extra.isNotNull(), F.concat(F.lit("\n## Extra context\n\n"), extra)),
        F.lit(T.FILES_HEADING), F.col("body"),
    )
    return out.select(*repos.columns, text.alias("text"), "n_files", "n_binaries", F.concat_ws("_", "owner", "repo").alias("skill_basename"))


def page_files(pages: DataFrame) -> DataFrame:
    """``pages(source_id, place, url, markdown, html)`` as files (source_id, rel, content): one page, or numbered ones."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    rows = pages.withColumn("n", n)
    many = F.concat(F.lit("page_"), F.lpad(F.col("place").cast("string"), 3, "0"), F.lit("_"), F.substring(X.slugify(F.col("url")), 1, 60), F.lit(".md"))
    md = rows.select("source_id", F.when(F.col("n") == 1, "page.md").otherwise(many).alias("rel"), F.col("markdown").alias("content"))
    html = rows.where("n = 1 and html <> ''").select("source_id", F.lit("page.html").alias("rel"), F.col("html").alias("content"))
    return md.unionByName(html)


def web_bundles(pages: DataFrame) -> DataFrame:
    """(source_id, text, pages_crawled): the only page's markdown, or all pages in order under separators."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    rows = pages.withColumn("n", n)
    head = F.concat(F.lit("\n\n===== PAGE "), F.col("place").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" — "), "url", F.lit(" =====\n\n"))
    shown = F.when(F.col("n") == 1, F.col("markdown")).otherwise(F.concat(head, F.coalesce("markdown", F.lit(""))))
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages_crawled"))
    return _listed(rows, "place", shown, "", "text").join(counts, "source_id")


def manifest_bundles(manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, text): the manifest, then its fetched ``entries(source_id, place, url, markdown)`` in order; failures are left out."""
    n = F.max("place").over(Window.partitionBy("source_id"))
    rows = entries.withColumn("n", n).where("markdown is not null")
    head = F.concat(F.lit("\n\n===== MANIFEST ENTRY "), F.col("place").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" — "), "url", F.lit(" =====\n\n"), "markdown")
    body = _listed(rows, "place", head, "", "body")
    out = manifests.join(body, "source_id", "left")
    return out.select("source_id", F.concat(F.lit("# llms.txt manifest: "), "url", F.lit("\n\n"), "text", F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def document_bundles(sources: DataFrame) -> DataFrame:
    """Texts and PDFs: ``sources(source_id, kind, url, text)`` with the one file's name and the base name."""
    last = F.substring_index("url", "/", -1)
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    name = F.when(F.col("kind") == "pdf", "document.txt").when(last == "", "page.txt").otherwise(last)
    return sources.withColumns({"rel": name, "skill_basename": X.slugify(F.when(F.col("kind") == "pdf", stem).otherwise(F.col("url")))})


def paper_files(papers: DataFrame) -> DataFrame:
    """``papers(source_id, html, pdf_text)`` as files (source_id, rel, content)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("rel"), F.col(c).alias("content")) for n, c in (("arxiv_html.md", "html"), ("arxiv_pdf.txt", "pdf_text"))])
    return papers.select("source_id", F.inline(pairs))
