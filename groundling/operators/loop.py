"""Generate, verify, repair: a bounded driver loop over tables of documents, with the model behind a function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import give_back, small_batches
from ..options import Options
from . import claims as C
from . import verify as V

Generator = Callable[[str, str], str]


def stub_generator(system: str, prompt: str) -> str:
    """Deterministic stand-in for a model: the source's first words as a document with one section."""
    source = prompt.split("---BEGIN SOURCE---\n")[-1].split("\n---END SOURCE---")[0]
    words = source.split()[:40]
    return "---\nname: stub\ndescription: generated\n---\n# Notes\n\n## Summary\n" + "\n".join(f'- "{w}"' for w in words) + "\n"


def with_retries(generate: Generator, attempts: int = 3, wait: Callable[[float], None] = lambda s: None) -> Generator:
    """A generator that tries again: after 20, 40 and 60 seconds if the limit of calls is reached (in the end, empty), after 5 for other errors (in the end, raised)."""

    def run(system: str, prompt: str) -> str:
        for k in range(1, attempts + 1):
            try:
                return generate(system, prompt) or ""
            except Exception as e:  # noqa: BLE001
                text = str(e).lower()
                if "safety" in text:
                    return ""
                limited = "429" in text or "rate" in text or "quota" in text
                if not limited and k == attempts:
                    raise
                wait(20.0 * k if limited else 5.0)
        return ""

    return run


def generate(prompts: DataFrame, generator: Generator) -> DataFrame:
    """``prompts(source_id, system, prompt)`` answered: (source_id, skill_text), without fences; one call a row, in the tasks."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"source_id": pdf["source_id"], "answer": [generator(s, p) or "" for s, p in zip(pdf["system"], pdf["prompt"])]})
        give_back()

    answers = small_batches(prompts).select("source_id", "system", "prompt").mapInPandas(run, "source_id long, answer string")
    return answers.select("source_id", X.clean_output(F.col("answer")).alias("skill_text"))


def first_prompts(bundles: DataFrame, budget: int) -> DataFrame:
    body = X.truncate_for_model(F.col("kind"), F.col("text"), budget)
    prompt = F.concat(F.lit("Source ("), "kind", F.lit(" — "), "url", F.lit("):\n\n---BEGIN SOURCE---\n"), body, F.lit("\n---END SOURCE---\n\nWrite the document now, from this source only."))
    return bundles.select("source_id", X.prompt_family(F.col("kind")).alias("system"), prompt.alias("prompt"))


def repair_prompts(skills: DataFrame, feedback: DataFrame, bundles: DataFrame, budget: int) -> DataFrame:
    """Prompts for documents with flagged lines; they show half the budget of source."""
    excerpt = bundles.select("source_id", X.truncate_for_model(F.col("kind"), F.col("text"), budget // 2).alias("excerpt"))
    rows = skills.join(feedback, "source_id").join(excerpt, "source_id")
    prompt = F.concat(F.lit("## Current document\n\n"), "skill_text", F.lit("\n\n## Lines with claims that are not in the source\n\n"), "feedback", F.lit("\n\n---BEGIN SOURCE---\n"), "excerpt", F.lit("\n---END SOURCE---\n\nWrite the corrected document."))
    return rows.select("source_id", F.lit("repair").alias("system"), prompt.alias("prompt"))


def accepted(new, old):
    """A repair counts if it is over two fifths as long as what it replaces."""
    return (new != "") & (F.length(new) > 0.4 * F.length(old))


def agentic_loop(bundles: DataFrame, generator: Generator, keep: Callable[[DataFrame, str], DataFrame], options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Documents of ``bundles(source_id, kind, url, text)``: (skills: source_id, round, skill_text, pct_verified; rounds).

    ``keep(df, name)`` writes a table to shared storage and reads it back, so that no answer is asked for twice and
    lineage ends each round.  A document leaves the loop when it meets the target, has no flagged line, gets a repair
    that is too short, or the rounds are used up; the earliest of its best rounds stays.
    """
    folded = keep(V.fold_sources(bundles), "folded")
    current = keep(generate(first_prompts(bundles, options.max_input_chars), generator), "round-0")
    texts, rounds = [], []
    for k in range(options.agentic_retries + 1):
        live = current.where(F.trim("skill_text") != "")
        lines = C.skill_lines(live, "source_id")
        verified = V.verify_claims(C.claims(lines, "source_id"), folded, "source_id")
        verified = keep(verified, f"verified-{k}")
        summary = keep(V.summaries(lines, V.section_stats(lines, verified, "source_id"), "source_id"), f"summary-{k}")
        checks = V.line_checks(lines, verified, "source_id")
        texts.append(live.withColumn("round", F.lit(k)))
        rounds.append(summary.withColumn("round", F.lit(k)))
        if k == options.agentic_retries:
            break
        unmet = summary.where(F.col("pct_verified") < options.target_pct_verified).select("source_id")
        prompts = repair_prompts(live.join(unmet, "source_id", "left_semi"), V.feedback_block(checks, "source_id"), bundles, options.max_input_chars)
        answers = generate(prompts, generator).withColumnRenamed("skill_text", "new")
        current = answers.join(live, "source_id").where(accepted(F.col("new"), F.col("skill_text"))).select("source_id", F.col("new").alias("skill_text"))
        current = keep(current, f"round-{k + 1}")
        if current.isEmpty():
            break
    all_texts, all_rounds = texts[0], rounds[0]
    for t, r in zip(texts[1:], rounds[1:]):
        all_texts, all_rounds = all_texts.unionByName(t), all_rounds.unionByName(r)
    best = V.best_round(all_rounds, "source_id")
    skills = best.withColumnRenamed("best_round", "round").join(all_texts, ["source_id", "round"])
    return skills, all_rounds
