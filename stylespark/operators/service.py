"""The service: generation with a gate, building of voices, jobs, directory. Models are injected; there is no network.

Driver-side control around DataFrame plans: a prompt, a candidate text and a verdict are single values.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from math import floor

import pandas as pd
from pyspark.sql import functions as F

# Fixed values.
ATTEMPTS, EXEMPLARS_SHOWN, FACTS_SHOWN, LEAST_EXEMPLARS, MOST_PULLED = 3, 3, 3, 5, 500


class InsufficientCorpusError(ValueError):
    """A register has too few exemplars for a profile."""


def hashed_embedder(dim: int = 64):
    """A deterministic offline embedder: hashed character trigrams, unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = [0.0] * dim
            for i in range(max(0, len(text or "") - 2)):
                v[int.from_bytes(hashlib.blake2b(text[i : i + 3].encode(), digest_size=4).digest(), "little") % dim] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            return [x / norm for x in v]

        return texts.map(one)

    return embed


@dataclass
class Verdict:
    verdict: str
    percentile: float
    gate_a: bool
    gate_b: str = "none"


def nudge(best: Verdict) -> str:
    """What to say before a retry: how near the best attempt was, in positive words."""
    return f"The best draft so far scores {floor(100 * best.percentile + 0.5)} of 100 for likeness. Come closer: sentence lengths, openings and habitual words as in the samples."


@dataclass
class Generated:
    text: str
    verdict: Verdict
    attempts: int
    cold_start: bool


def generate(prompt: Callable[[str | None], str], model: Callable[[str], str], evaluate: Callable[[str], Verdict] | None) -> Generated:
    """Up to ATTEMPTS drafts, until one reaches the style gate's threshold; else the best by percentile, the earliest on ties.
    Without a profile (evaluate is None): one draft, for review."""
    if evaluate is None:
        if not (text := model(prompt(None))):
            raise ValueError("the model gave no text")
        return Generated(text, Verdict("REVIEW", 0.0, False), 1, True)
    best: Generated | None = None
    for attempt in range(1, ATTEMPTS + 1):
        text = model(prompt(nudge(best.verdict) if best else None))
        if not text:
            raise ValueError("the model gave no text")
        got = evaluate(text)
        if best is None or got.percentile > best.verdict.percentile:
            best = Generated(text, got, attempt, False)
        if got.gate_a:
            return Generated(text, got, attempt, False)
    best.attempts = ATTEMPTS
    return best


@dataclass
class Jobs:
    """States of jobs of this process."""

    states: dict[str, dict] = field(default_factory=dict)
    ids: count = field(default_factory=lambda: count(1))
    lock: threading.Lock = field(default_factory=threading.Lock)

    def start(self, work: Callable[[], object]) -> tuple[str, threading.Thread]:
        with self.lock:
            name = f"job_{next(self.ids)}"
            self.states[name] = {"status": "running"}

        def run() -> None:
            try:
                state = {"status": "succeeded", "result": work()}
            except Exception as e:  # noqa: BLE001  a job's failure is its state
                state = {"status": "failed", "error": str(e)}
            self.states[name] = state

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return name, thread

    def get(self, name: str) -> dict | None:
        return self.states.get(name)


def build_registers(counts: dict[str, int], build: Callable[[str], None]) -> tuple[list[str], list[str]]:
    """Build each register in order; thin ones are skipped, other errors end the build and leave earlier ones live."""
    built, skipped = [], []
    for register, n in counts.items():
        try:
            if n < LEAST_EXEMPLARS:
                raise InsufficientCorpusError(f"{register}: {n} exemplars")
            build(register)
            built.append(register)
        except InsufficientCorpusError:
            skipped.append(register)
    return built, skipped
