"""Run options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """What a run may set; the defaults are those of the command line it stands for."""

    output: str = "./skills"
    max_input_chars: int = 350_000
    max_org_repos: int = 25
    crawl_pages: int = 25
    max_repo_mb: int = 800
    agentic_retries: int = 2
    target_pct_verified: float = 90.0
    no_llm: bool = False
    annotate_skill: bool = False
    skip_verify: bool = False
    json_output: bool = False
    verbatim_mode: str = "auto"  # auto, always, never
    verbatim_threshold: float = 92.0
    verbatim_fallback_threshold: int = 1500
