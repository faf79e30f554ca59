"""Claims against their own source: folded, boundary-aware containment, rolled up per line, section and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T
from ..functions import text as X

_BARE = r"^\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def number_in(v: Column, source: Column) -> Column:
    """A number stands in the source with no digit, point or exponent beside it; with its unit, or else without."""

    def at(x):
        return source.contains(x) & F.rlike(source, F.concat(F.lit(r"(?<![\d.eE+\-])"), X.escaped(x), F.lit(r"(?![\d.eE])")))

    bare = F.regexp_extract(v, _BARE, 0)
    return at(v) | ((bare != "") & (bare != v) & at(bare))


def words_in(v: Column, source: Column) -> Column:
    """A value stands in the source as whole words; its white space matches any white space."""
    first = F.regexp_extract(v, r"\S+", 0)
    pattern = F.concat(F.lit(r"(?<!\w)"), F.regexp_replace(X.escaped(v), r"\s+", r"\\s+"), F.lit(r"(?!\w)"))
    return source.contains(first) & F.rlike(source, pattern)


def in_source(norm_value: Column, ctype: Column, source: Column) -> Column:
    """Whether a folded claim is found in a folded source; an empty one always is."""
    v = X.strip(norm_value)
    url = F.regexp_replace(v, r"[.,;)\]}>]+\z", "")
    return F.when(v == "", True).when(ctype == "number", number_in(v, source)).when(ctype == "url", source.contains(url)).otherwise(words_in(v, source))


def fold_sources(bundles: DataFrame) -> DataFrame:
    """(source_id, norm_src): folded once a source, not once a claim or round."""
    return bundles.select("source_id", X.norm_text("text").alias("norm_src"))


def verify_claims(claims: DataFrame, folded: DataFrame, *keys: str) -> DataFrame:
    """``claims`` with ``verified``. ``keys`` hold source_id.

    Each source meets its claims in one row, each distinct value once with the claims that make it, so a source's text is
    neither copied to its claims nor joined with those of others, and claims are shuffled once.  A source that is missing
    holds nothing.
    """
    kind = F.when(F.col("ctype").isin("number", "url"), F.col("ctype")).otherwise("words").alias("kind")
    rest = [c for c in claims.columns if c not in ("source_id", "norm_value")]
    rows = claims.select("source_id", "norm_value", kind, F.struct(*rest).alias("c")).repartition("source_id")
    asked = rows.groupBy("source_id", "norm_value", "kind").agg(F.collect_list("c").alias("cs")).groupBy("source_id").agg(F.collect_list(F.struct("norm_value", "kind", "cs")).alias("asked"))
    met = asked.join(folded, "source_id", "left").withColumn("norm_src", F.coalesce("norm_src", F.lit("")))
    told = F.transform("asked", lambda a: F.struct(a["norm_value"].alias("norm_value"), a["cs"].alias("cs"), in_source(a["norm_value"], a["kind"], F.col("norm_src")).alias("verified")))
    flags = met.select("source_id", F.inline(told)).select("source_id", "norm_value", F.explode("cs").alias("c"), "verified")
    return flags.select("source_id", "norm_value", "c.*", "verified").select(*claims.columns, "verified")


def line_checks(lines: DataFrame, verified: DataFrame, *keys: str) -> DataFrame:
    """Lines with an unverified claim: (keys.., line_no, line, section, claims_total, claims_unverified as type:value in order)."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("verified"), F.struct("claim_seq", F.concat_ws(":", "ctype", "value").alias("c")))))
    per = verified.groupBy(*keys, "line_no").agg(F.count(F.lit(1)).alias("claims_total"), F.transform(bad, lambda x: x["c"]).alias("claims_unverified"))
    return lines.select(*keys, "line_no", "line", "section").join(per.where(F.size("claims_unverified") > 0), [*keys, "line_no"])


def _pct(bad: Column, total: Column) -> Column:
    return F.when(total > 0, (1.0 - bad / total) * 100).otherwise(100.0)


def section_stats(lines: DataFrame, verified: DataFrame, *keys: str) -> DataFrame:
    """(keys.., section, first_line, claims_total, claims_unverified, pct_verified, lines, flagged_lines), one pass over lines."""
    per = verified.groupBy(*keys, "line_no").agg(F.count(F.lit(1)).alias("t"), F.count_if(~F.col("verified")).alias("u"))
    rows = lines.where(~F.col("is_skipped")).join(per, [*keys, "line_no"], "left")
    total, bad = F.coalesce(F.sum("t"), F.lit(0)).cast("long"), F.coalesce(F.sum("u"), F.lit(0)).cast("long")
    out = rows.groupBy(*keys, "section").agg(
        F.min("line_no").alias("first_line"), total.alias("claims_total"), bad.alias("claims_unverified"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col("u") > 0).alias("flagged_lines")
    )
    return out.withColumn("pct_verified", _pct(F.col("claims_unverified"), F.col("claims_total")))


def summaries(lines: DataFrame, sections: DataFrame, *keys: str) -> DataFrame:
    """(keys.., total_lines_checked, lines_flagged, claims_total, claims_unverified, pct_verified, per_section worst first)."""
    counted = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_lines_checked"))
    entry = F.struct("pct_verified", "first_line", "section", "claims_total", "claims_unverified", "lines", "flagged_lines")
    sums = sections.groupBy(*keys).agg(
        F.sum("flagged_lines").alias("lines_flagged"), F.sum("claims_total").alias("claims_total"), F.sum("claims_unverified").alias("claims_unverified"), F.array_sort(F.collect_list(entry)).alias("per_section")
    )
    out = counted.join(sums, list(keys), "left")
    out = out.select(*keys, "total_lines_checked", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("lines_flagged", "claims_total", "claims_unverified")], F.coalesce("per_section", F.array()).alias("per_section"))
    return out.withColumn("pct_verified", _pct(F.col("claims_unverified"), F.col("claims_total")))


def worst_section(sections: DataFrame, *keys: str) -> DataFrame:
    """Per document the lowest section with 3 claims or more that is below the whole: (keys.., section, pct_verified)."""
    whole = sections.groupBy(*keys).agg(F.sum("claims_total").alias("t"), F.sum("claims_unverified").alias("u")).select(*keys, _pct(F.col("u"), F.col("t")).alias("whole"))
    low = sections.join(whole, list(keys)).where((F.col("claims_total") >= 3) & (F.col("pct_verified") < F.col("whole")))
    return low.groupBy(*keys).agg(F.min(F.struct("pct_verified", "first_line", "section")).alias("m")).select(*keys, "m.section", "m.pct_verified")


def dangerous_sections(sections: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Sections with 3 claims or more below the threshold that have a risky name or are over 5 points below it."""
    risky = F.col("section").rlike("(?i)" + "|".join(T.DANGEROUS_SECTIONS)) | (F.col("pct_verified") < threshold - 5)
    return sections.where((F.col("claims_total") >= 3) & (F.col("pct_verified") < threshold) & risky)


def guard_trigger(kind: Column, has_dangerous: Column, mode: str = "auto", no_llm: bool = False, skip_verify: bool = False) -> Column:
    """Whether the verbatim companion is written."""
    if mode == "never" or no_llm:
        return F.lit(False)
    guarded = kind.isin(*T.GUARDED_KINDS)
    if mode == "always":
        return guarded
    return guarded & F.lit(not skip_verify) & (has_dangerous | kind.isin(*T.REPO_EXTRACTED_KINDS))


def feedback_block(checks: DataFrame, *keys: str, lines: int = 40, width: int = 160, claims: int = 6) -> DataFrame:
    """(keys.., feedback): the first flagged lines with their claims, as a repair prompt shows them."""
    n = F.size("claims_unverified")
    shown = F.concat(F.array_join(F.slice("claims_unverified", 1, claims), ", "), F.when(n > claims, F.concat(F.lit(", +"), (n - claims).cast("string"), F.lit(" more"))).otherwise(""))
    text = F.concat(F.lit("- Line "), F.col("line_no").cast("string"), F.lit(": "), F.substring("line", 1, width), F.lit("\n  Unverified claims: "), shown)
    first = checks.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))).where(F.col("n") <= lines)
    g = first.select(*keys, "n", text.alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("l"))
    return g.select(*keys, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("feedback"))


def best_round(rounds: DataFrame, *keys: str) -> DataFrame:
    """``rounds(keys.., round, pct_verified, ..)``: (keys.., best_round, pct_verified), the earliest of the best.

    A document whose rounds all have 0 % keeps its last round, with 0.
    """
    top = F.max(F.struct("pct_verified", (-F.col("round")).alias("r"))).alias("top")
    g = rounds.groupBy(*keys).agg(top, F.max("round").alias("last"))
    return g.select(*keys, F.when(F.col("top.pct_verified") > 0, -F.col("top.r")).otherwise(F.col("last")).alias("best_round"), F.greatest(F.col("top.pct_verified"), F.lit(0.0)).alias("pct_verified"))


def status_rollup(results: DataFrame) -> DataFrame:
    """One row: results that are ok, raw only and failed; skipped and empty ones are not counted."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "raw_only", "error")])


#: Passages that are sent to all tasks at a time.
PASSAGE_BLOCK = 100_000


def passage_hits(docs: DataFrame, items: DataFrame, block: int = PASSAGE_BLOCK) -> DataFrame:
    """(item_id, n_docs, first_doc) of ``items(item_id, v)``, folded passages, in ``docs(doc_id, norm_src)``, folded texts.

    A passage that stands in a text as whole words has all its words there, so its longest word is its key: documents
    post their distinct words, meet the keys in a broadcast join, and only where a key is met is the passage looked for.
    A passage without any word has the empty key, which every document posts.  Passages go out in blocks of about
    ``block``, so that what is sent stays bounded; documents are never shuffled.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0))
    rows = items.select("item_id", X.strip(F.coalesce("v", F.lit(""))).alias("v"))
    longest = F.array_max(F.transform(words("v"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = rows.where("v <> ''").select("item_id", "v", F.coalesce(longest, F.lit("")).alias("word"))
    blocks = max(1, -(-keyed.count() // block))
    posts = docs.select("doc_id", "norm_src", F.explode(F.array_union(words("norm_src"), F.array(F.lit("")))).alias("word"))
    found = None
    for k in range(blocks):
        own = keyed.where(F.pmod(F.xxhash64("item_id", "v"), F.lit(blocks)) == k)
        met = posts.join(F.broadcast(own), "word").where(words_in(F.col("v"), F.col("norm_src")))
        part = met.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("item_id").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))
    return rows.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "first_doc")
