"""Reports and sinks: annotated text, directive, names, verification report, result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T
from ..functions import text as X


def annotate(lines: DataFrame, checks: DataFrame, *keys: str, values: int = 4) -> DataFrame:
    """(keys.., annotated): the text with a comment behind each flagged line. ``lines`` are all lines of a document."""
    plain = F.transform(F.slice("claims_unverified", 1, values), lambda c: F.regexp_replace(c, "^[^:]*:", ""))
    n = F.size("claims_unverified")
    note = F.concat(F.lit("  <!-- ⚠ UNVERIFIED: "), F.array_join(plain, ", "), F.when(n > values, F.concat(F.lit(", +"), (n - values).cast("string"), F.lit(" more"))).otherwise(""), F.lit(" -->"))
    rows = lines.join(checks.select(*keys, "line_no", note.alias("note")), [*keys, "line_no"], "left")
    rows = rows.select(*keys, "line_no", F.concat("line", F.coalesce("note", F.lit(""))).alias("t"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("l"))
    return g.select(*keys, F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n")).alias("annotated"))


def flagged_names(sections: Column, most: int = 5) -> Column:
    """Names with their share of an array of (section, pct_verified), worst first as given; or that none was flagged."""
    shown = F.transform(F.slice(sections, 1, most), lambda s: F.concat(F.lit("_"), s["section"], F.lit("_ ("), X.tenths(s["pct_verified"]), F.lit("%)")))
    n = F.size(sections)
    more = F.when(n > most, F.concat(F.lit(", +"), (n - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n > 0, F.concat(F.array_join(shown, ", "), more)).otherwise("(precautionary — no specific sections flagged)")


def inject_directive(text: Column, sections: Column) -> Column:
    """The text with a trust notice behind its front matter, else at its top; unchanged if the marker is there."""
    notice = F.concat(
        F.lit(T.DIRECTIVE_MARKER + "\n> **⚠ Check identifiers before writing code**\n>\n> Parts of this document could not be verified against its source: "),
        flagged_names(sections),
        F.lit("\n>\n> Take names, parameters, types, constants, configuration keys and paths from `VERBATIM_REFERENCE.md`, which is copied\n> from the source. What stands only here is unverified.\n"),
    )
    front = F.regexp_extract(text, r"(?s)\A(---\s*\n.*?\n---\s*\n)", 1)
    body = F.substring(text, F.length(front) + 1, F.length(text))
    return F.when(text.contains(T.DIRECTIVE_MARKER), text).otherwise(F.concat(front, F.when(front == "", "").otherwise("\n"), notice, F.lit("\n"), body))


def safe_name(name: Column) -> Column:
    """A name that cannot leave the output folder. Divergence: names that are generated are not trusted."""
    return F.when(name.rlike(r"[/\\]|^\.{0,2}$"), X.slugify(F.regexp_replace(name, r"\.{2,}", "_"))).otherwise(name)


def skill_keys(skills: DataFrame) -> DataFrame:
    """``skills(source_id, name, url)`` with skill_key: a name is its first source's; other urls get six digits of their hash."""
    w = Window.partitionBy("name").orderBy("source_id")
    owner = F.first("url").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return skills.withColumn("skill_key", F.when((F.col("url") == "") | (F.col("url") == owner), F.col("name")).otherwise(F.concat("name", F.lit("__"), X.short_hash(F.col("url"), 6))))


def skill_files(skills: DataFrame, stored: DataFrame, stamp: str) -> DataFrame:
    """(skill_key, rel, content): what saving ``skills(skill_key, url, text)`` writes next to ``stored(skill_key, url, text)``.

    A stored document of another source keeps its name, and the new one gets six digits of its url's hash; a document that
    is there already under the name goes to a backup, whose name has the ``stamp``.
    """
    had = stored.select(F.col("skill_key").alias("k"), F.col("url").alias("had_url"), F.col("text").alias("had"))
    taken = (F.coalesce("had_url", F.lit("")) != "") & (F.col("url") != "") & (F.col("had_url") != F.col("url"))
    rows = skills.join(had, F.col("skill_key") == F.col("k"), "left")
    rows = rows.select(F.when(taken, F.concat("skill_key", F.lit("__"), X.short_hash(F.col("url"), 6))).otherwise(F.col("skill_key")).alias("skill_key"), "url", "text")
    rows = rows.join(had, F.col("skill_key") == F.col("k"), "left")
    kinds = F.array(
        F.struct(F.lit("SKILL.md").alias("rel"), F.col("text").alias("content")),
        F.when(F.col("url") != "", F.struct(F.lit(".source_url").alias("rel"), F.col("url").alias("content"))),
        F.when(F.col("had").isNotNull(), F.struct(F.lit(f"SKILL_prev_{stamp}.md").alias("rel"), F.col("had").alias("content"))),
    )
    return rows.select("skill_key", F.explode(F.filter(kinds, lambda f: f.isNotNull())).alias("f")).select("skill_key", "f.*")


MARKS = {"ok": "✓", "raw_only": "○", "error": "✗", "skipped": "⏭", "empty_llm": "✗"}


def console_summary(records: DataFrame) -> DataFrame:
    """(place, line): the closing lines of a run over ``records(place, raw, kind, status, pct_verified, error)``, place 0 first."""
    status = F.coalesce("status", F.lit(""))
    count = lambda name: F.count_if(status == name).cast("string")
    head = records.agg(F.concat(F.lit("DONE: "), count("ok"), F.lit(" ok, "), count("raw_only"), F.lit(" raw-only, "), count("error"), F.lit(" errored")).alias("line"))
    mark = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), status), F.lit("?"))
    kind = F.coalesce("kind", F.lit("?"))
    share = F.when(F.col("pct_verified") >= 0, F.concat(F.lit("  ("), X.tenths(F.col("pct_verified")), F.lit("% verified)"))).otherwise("")
    failed = F.when(status == "error", F.concat(F.lit("  — "), F.substring(F.coalesce("error", F.lit("")), 1, 60))).otherwise("")
    line = F.concat(F.lit("  "), mark, F.lit(" ["), F.rpad(kind, F.greatest(F.lit(14), F.length(kind)), F.lit(" ")), F.lit("] "), F.coalesce("raw", F.lit("?")), F.coalesce(share, F.lit("")), failed)
    return head.select(F.lit(0).cast("long").alias("place"), "line").unionByName(records.select(F.col("place").cast("long").alias("place"), line.alias("line")))


def verification_report(summaries: DataFrame, checks: DataFrame, *keys: str) -> DataFrame:
    """(keys.., report): summary, sections with claims, and every flagged line with its claims."""
    pct = lambda c: F.concat(X.tenths(c), F.lit("%"))
    cell = lambda *xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    rows = F.transform(
        F.filter("per_section", lambda s: s["claims_total"] > 0),
        lambda s: cell(s["section"], s["claims_total"].cast("string"), s["claims_unverified"].cast("string"), pct(s["pct_verified"]), F.concat_ws("/", s["flagged_lines"].cast("string"), s["lines"].cast("string"))),
    )
    n = F.size("claims_unverified")
    block = F.concat(
        F.lit("### Line "), F.col("line_no").cast("string"), F.lit(" — section: _"), "section", F.lit("_\n\n> "), F.substring("line", 1, 300), F.lit("\n\nUnverified ("), n.cast("string"), F.lit(" of "),
        F.col("claims_total").cast("string"), F.lit("):\n"), F.array_join(F.transform("claims_unverified", lambda c: F.concat(F.lit("- `"), c, F.lit("`"))), "\n"), F.lit("\n"),
    )
    flagged = checks.select(*keys, "line_no", block.alias("b")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "b"))).alias("l"))
    flagged = flagged.select(*keys, F.array_join(F.transform("l", lambda x: x["b"]), "\n").alias("flagged"))
    s = lambda c: F.col(c).cast("string")
    head = F.concat(
        F.lit("# Verification report\n\n## Summary\n- Total claims checked: **"), s("claims_total"), F.lit("**\n- Unverified claims: **"), s("claims_unverified"), F.lit("**\n- Lines flagged: **"), s("lines_flagged"), F.lit("** of "),
        s("total_lines_checked"), F.lit("\n- Overall verified: **"), pct(F.col("pct_verified")), F.lit("**\n\n## Per-section breakdown\n\n| Section | Claims | Unverified | % verified | Lines flagged |\n| --- | ---: | ---: | ---: | ---: |\n"),
        F.array_join(rows, "\n"), F.lit("\n\n"),
    )
    out = summaries.join(flagged, list(keys), "left")
    return out.select(*keys, F.concat(head, F.coalesce(F.concat(F.lit("## Flagged lines\n\n"), "flagged"), F.lit("No unverified claims found."))).alias("report"))


def result_records(results: DataFrame) -> DataFrame:
    """``results`` as JSON lines: (json), percentages with one decimal; what is null is left out."""
    cols = [X.tenths(F.col("pct_verified")).cast("double").alias("pct_verified") if c == "pct_verified" else F.col(c) for c in results.columns]
    return results.select(F.to_json(F.struct(*cols)).alias("json"))


def quality_grade(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys.., n_lines, grade) by length: 250, 400 and 500 lines. An extension after the published format targets."""
    n = F.col("n_lines")
    grade = F.when(n >= 500, "excellent").when(n >= 400, "good").when(n >= 250, "minimum").otherwise("below")
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines")).withColumn("grade", grade)


def write_bundles(bundles: DataFrame, files: DataFrame, path: str) -> None:
    """Bundles and their files as Parquet by kind; files whose path leaves its folder are left out."""
    bundles.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/bundles")
    safe = X.safe_join("/files", F.col("rel"))
    files.where(safe.isNotNull() & (safe != "/files")).write.mode("overwrite").parquet(f"{path}/files")


def write_json(results: DataFrame, path: str) -> None:
    result_records(results).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, column: str, path: str) -> None:
    """One text a row (reports, raw dumps, documents) with its key columns, as Parquet: a text holds line ends."""
    df.where(F.col(column).isNotNull()).write.mode("overwrite").parquet(path)
