"""Prompt texts: a tree of files, their composition, and the gate that keeps labels out of them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from netquarry.operators import lint
from netquarry.operators.tools import GROUND_TRUTH
from netquarry.sources import artifacts

SUBMIT = "submit_assessment"


class ForbiddenToken(ValueError):
    pass


@dataclass(frozen=True)
class Prompts:
    common: str
    personas: dict[str, str]
    playbooks: dict[str, str]


def load(spark: SparkSession, root: str) -> Prompts:
    """The tree root/playbook_common.md, root/personas/*.md, root/playbooks/*.md; each persona must have a playbook and each playbook a persona."""
    root = root.rstrip("/")

    def texts(folder: str) -> dict[str, str]:
        p, fs = artifacts._path(spark, f"{root}/{folder}")
        found = {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(p)}
        return {name[:-3]: artifacts.read_text(spark, at) for name, at in sorted(found.items()) if name.endswith(".md")}

    out = Prompts(artifacts.read_text(spark, f"{root}/playbook_common.md"), texts("personas"), texts("playbooks"))
    if odd := sorted(set(out.personas) ^ set(out.playbooks)):
        raise ValueError(f"personas and playbooks do not match: {odd}")
    return out


def check(text: str, families: list[str], where: str = "text") -> None:
    """Raises at the first rule that the text breaks, with the match and its place."""
    for name, pattern in lint.patterns([*GROUND_TRUTH, *lint.LABELS], families):
        if m := re.search(pattern, text):
            raise ForbiddenToken(f"{where} has a {name} at {m.start()}: {m.group(0)!r}")


def tools_under(ablation: str, tools: list[dict]) -> list[dict]:
    """The tools left by an ablation: without tools, only the submission."""
    return [t for t in tools if t.get("name") == SUBMIT] if ablation in ("tools_off", "single_shot_baseline") else tools


def compose(prompts: Prompts, persona: str, ablation: str, scaffold: str, contract: dict, tools: list[dict], families: list[str]) -> str:
    """The system prompt of a persona under an ablation, checked for forbidden tokens; without playbooks the persona's own one is left out."""
    if persona not in prompts.personas:
        raise LookupError(f"no persona {persona}")
    # The sections' titles and their order.
    shown = lambda value: f"```json\n{json.dumps(value, indent=2, sort_keys=True)}\n```"
    parts = {"System": scaffold, "Output Contract": shown(contract), "Persona": prompts.personas[persona], "Common Playbook": prompts.common}
    if ablation != "playbooks_off":
        parts["Persona Playbook"] = prompts.playbooks[persona]
    parts["Tools"] = shown(tools_under(ablation, tools))
    text = "\n\n".join(f"# {title}\n{body}" for title, body in parts.items())
    check(text, families, f"prompt of {persona} under {ablation}")
    return text
