"""What a model is told: one system prompt a family of sources, one for repairs. Wording of our own."""

from __future__ import annotations

from collections.abc import Callable

_RULES = (
    "Use the source between the markers and nothing else. Copy names, numbers, units, paths and code exactly as the source has them; put code names in backticks and literal "
    "phrases in double quotes. Leave out what the source does not say. Write markdown with front matter (name, description) and one '## ' heading per section."
)
SYSTEM = {
    "paper": "You turn a research paper into a working reference. Cover the problem, the method step by step with its equations and hyperparameters, the data, the results with their numbers, and the limits. " + _RULES,
    "repo": "You turn a code repository into a working reference. Cover its purpose, installation, layout, public interface with literal signatures, configuration, usage examples taken from the files, and pitfalls. " + _RULES,
    "web": "You turn documentation pages into a working reference. Cover the concepts, the interface with literal names and parameters, the procedures in order, the examples as they stand, limits and errors. " + _RULES,
    "repair": "You correct a reference whose checker found claims that the source does not hold. Remove or replace every one of them by what the source says, change nothing else, add no new claims, and return the whole document. " + _RULES,
}


def with_system_prompts(generator: Callable[[str, str], str]) -> Callable[[str, str], str]:
    """A generator for the loop, which names a family: the model gets the family's system prompt."""

    def run(family: str, prompt: str) -> str:
        return generator(SYSTEM.get(family, family), prompt)

    return run
