"""Stand-ins for models in the registered queries: what a worker loads is a function of prompts."""

from __future__ import annotations

import json


def letters():
    """Scores a pair by how much of the text is the question's first letter."""
    return lambda prompts: [str(_share(*json.loads(p))) for p in prompts]


def _share(question: str, text: str) -> float:
    letter = question[:1].lower()
    return round(text.lower().count(letter) / max(1, len(text)), 6) if letter else 0.0


def brittle():
    """The same, but it fails on texts of an odd length."""

    def run(prompts: list[str]) -> list[str]:
        if any(len(json.loads(p)[1]) % 2 for p in prompts):
            raise RuntimeError("odd")
        return [str(_share(*json.loads(p))) for p in prompts]

    return run
