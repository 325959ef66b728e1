"""The engine's tools: checked inputs, and results cut down to what their schemas name, so that nothing else of a corpus leaves.

A schema is a function of a value that returns the accepted value or raises ValueError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from stylespark.operators.retrieval import REGISTERS

# Caps and names.
MOST_TEXT, MOST_ID, MOST_SOURCES = 100_000, 256, 16
VERDICTS, READINESS = ("PASS", "REVIEW", "FAIL"), ("insufficient", "generation-ready", "profile-grade")
STRICTNESS, SOURCES, LENGTHS = ("lenient", "standard", "strict"), ("email", "matrix"), ("short", "medium", "long")

Schema = Callable[[object], object]


def text(least: int = 0, most: int | None = None) -> Schema:
    def check(v: object) -> str:
        if not isinstance(v, str) or len(v) < least or (most is not None and len(v) > most):
            raise ValueError(f"a text of {least} to {most if most is not None else 'any number of'} characters is needed")
        return v

    return check


def one_of(names: tuple[str, ...]) -> Schema:
    def check(v: object) -> str:
        if v not in names:
            raise ValueError(f"one of {', '.join(names)} is needed")
        return v

    return check


def share(v: object) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1:
        raise ValueError("a number from 0 to 1 is needed")
    return v


def flag(v: object) -> bool:
    if not isinstance(v, bool):
        raise ValueError("true or false is needed")
    return v


def many(each: Schema, least: int = 0, most: int | None = None) -> Schema:
    def check(v: object) -> list:
        if not isinstance(v, (list, tuple)) or len(v) < least or (most is not None and len(v) > most):
            raise ValueError("a list of another length is needed")
        return [each(x) for x in v]

    return check


def nullable(schema: Schema) -> Schema:
    return lambda v: None if v is None else schema(v)


def record(needed: dict[str, Schema], optional: dict[str, Schema] | None = None) -> Schema:
    """Needed and optional fields; all others are dropped."""

    def check(v: object) -> dict:
        if not isinstance(v, dict):
            raise ValueError("fields are needed")
        out = {}
        for name, schema in {**needed, **(optional or {})}.items():
            if name not in v:
                if name in needed:
                    raise ValueError(f"{name} is needed")
                continue
            try:
                out[name] = schema(v[name])
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from e
        return out

    return check


_body, _id, _register = text(1, MOST_TEXT), text(1, MOST_ID), one_of(REGISTERS)
_draft = {
    "text": text(), "verdict": one_of(VERDICTS), "scores": record({"stylometric_similarity": share, "ai_detector_prob": share, "register_fit": share}),
    "gate": record({"passed": flag, "failed_checks": many(text())}), "register": _register, "voice_id": text(),
}
_repaired = record({**_draft, "ai_detector_prob_before": share, "ai_detector_prob_after": share})
_draft = record(_draft)
_voices = record({"voices": many(record({"voice_id": text(), "registers_ready": many(_register)}))})
_status = record({"voice_id": text(), "registers": many(record({"register": _register, "readiness": one_of(READINESS), "coverage": share, "last_eval": nullable(text())}))})


@dataclass(frozen=True)
class Tool:
    accepts: Schema
    returns: Schema
    run: Callable[[object, dict], dict]
    reads_only: bool = True

    def __call__(self, engine: object, payload: object) -> dict:
        return self.returns(self.run(engine, self.accepts(payload)))


def _listed(engine, _: dict) -> dict:
    return {"voices": [{"voice_id": r.author_id, "registers_ready": list(r.registers)} for r in engine.list_voices().collect()]}


def _told(engine, given: dict) -> dict:
    rows = engine.voice_status(given["voice_id"]).collect()
    return {"voice_id": given["voice_id"], "registers": [{**r.asDict(), "last_eval": None if r.last_eval is None else str(r.last_eval)} for r in rows]}


TOOLS = {
    "voice_generate": Tool(
        record({"brief": _body, "voice_id": _id, "register": _register}, {"knobs": record({}, {"grounding_query": text(), "length": one_of(LENGTHS)})}), _draft,
        lambda e, x: e.generate(x["voice_id"], x["register"], x["brief"], x.get("knobs", {}).get("grounding_query")),
    ),
    "voice_rewrite": Tool(record({"text": _body, "voice_id": _id, "register": _register}, {"strictness": one_of(STRICTNESS)}), _draft, lambda e, x: e.rewrite(x["voice_id"], x["register"], x["text"], x.get("strictness"))),
    "voice_deai": Tool(record({"text": _body, "register": _register}, {"voice_id": _id, "strictness": one_of(STRICTNESS)}), _repaired, lambda e, x: e.deai(x["text"], x["register"], x.get("strictness", "standard"), x.get("voice_id", ""))),
    "voice_transform": Tool(record({"text": _body, "to_voice": _id, "register": _register}, {"from_voice": _id}), _draft, lambda e, x: e.transform(x["to_voice"], x["register"], x["text"])),
    "voice_add": Tool(record({"voice_id": _id, "sources": many(one_of(SOURCES), 1, MOST_SOURCES)}, {"corpus_ref": text(0, MOST_ID)}), record({"job_id": text()}), lambda e, x: {"job_id": e.add_from(**x)}, reads_only=False),
    "voice_list": Tool(record({}), _voices, _listed),
    "voice_status": Tool(record({"voice_id": _id}), _status, _told),
}


def call(engine: object, name: str, payload: object) -> dict:
    """Run a tool by name: bad input raises ValueError before the engine is asked, and the result holds its schema's fields only."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    return TOOLS[name](engine, payload)
