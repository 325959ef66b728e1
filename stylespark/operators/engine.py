"""The voice engine: profiles built from stored exemplars, gated drafts, rewrites, repairs, jobs and the directory.

Corpora, exemplars and calibration are DataFrame plans. What comes to the driver is one profile (VOCABULARY words,
at most MOST_PULLED + impostors scores) or one text. Models are injected callables.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylespark.functions.text import WORD
from stylespark.operators import assemble, deai, gate, retrieval, stylometry
from stylespark.operators.accounting import PROFILE_EXEMPLARS
from stylespark.operators.ingest import ingest
from stylespark.operators.service import EXEMPLARS_SHOWN, FACTS_SHOWN, LEAST_EXEMPLARS, MOST_PULLED, InsufficientCorpusError, Jobs, Verdict, build_registers, generate
from stylespark.operators.store import Store, other_authors, status, voices
from stylespark.operators.tools import MOST_ID, MOST_TEXT, many, record
from stylespark.operators.tools import text as text_of
from stylespark.runtime import settled

PROSE_SHOWN = 8
PROSE = {"voice_summary": str, "habits": list, "do_more_of": list}
PROSE_ASK = 'Describe how the author of these messages writes. Answer with one JSON object: {"voice_summary": text, "habits": [texts], "do_more_of": [texts]}. Say only what to do.'
REWRITE = "Say the message below again as this author would, with every fact, name and number in it.\n\n"
CARD = "targets struct<sentence_len_mean: double, sentence_len_variance: double, contraction_rate: double, emoji_rate: double, lowercase_start_rate: double, signature_ngrams: array<string>>, prose struct<voice_summary: string, habits: array<string>, do_more_of: array<string>>"
#: Everyday texts by nobody in particular, so that a lone author has others to be told from.
BUNDLED = (
    "The shop opens at nine and closes at six, and on Sundays it stays closed all day for everyone.",
    "Please bring the forms to the desk on the second floor before the end of the month.",
    "It rained in the morning, so the match was moved to the hall behind the old school.",
    "The new printer takes both sizes of paper, but the lower tray has to be pushed in firmly.",
    "Our next meeting is on Thursday in the large room, and lunch will be brought at noon.",
    "Peel the potatoes, cut them in halves, and let them boil in salted water until soft.",
    "The bus to the station leaves from the other side of the square while the road is being mended.",
    "All parcels that arrive after four are put on the shelf and given out the next day.",
    "Tickets are sold at the counter near the gate until a quarter of an hour before the start.",
    "Water the plants by the window twice a week, and turn the pots so that they grow straight.",
)


_number = {"sentence_len_mean", "sentence_len_variance", "contraction_rate", "emoji_rate", "lowercase_start_rate"}


def _real(v: object) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError("a number is needed")
    return v


#: What a stored style card must hold; a card that doesn't raises when it is read.
_card = record({"targets": record({**dict.fromkeys(sorted(_number), _real), "signature_ngrams": many(text_of())}), "prose": record({"voice_summary": text_of(), "habits": many(text_of()), "do_more_of": many(text_of())})})


def checked_input(text: str | None = None, voice_id: str | None = None) -> None:
    """Caps of the engine's inputs."""
    for value, most in ((text, MOST_TEXT), (voice_id, MOST_ID)):
        if value is not None:
            text_of(1, most)(value)


def prose_of(texts: list[str], model: Callable[[str], str]) -> dict:
    """The model's description of a style as voice_summary, habits and do_more_of; anything else fails."""
    shown = "\n\n".join(f"EXAMPLE {i}:\n{t}" for i, t in enumerate(texts, 1))
    reply = (model(f"{PROSE_ASK}{assemble.RULE}{shown}") or "").strip()
    if reply.startswith("```"):
        reply = re.sub(r"^```(?:json)?\s*|\s*```$", "", reply)
    try:
        got = json.loads(reply)
    except json.JSONDecodeError as e:
        raise ValueError("the style description isn't JSON") from e
    if not isinstance(got, dict) or any(not isinstance(got.get(k), t) for k, t in PROSE.items()) or any(not isinstance(x, str) for k in ("habits", "do_more_of") for x in got[k]):
        raise ValueError("the style description lacks a field")
    return {k: got[k] for k in PROSE}


def impostors_for(exemplars: DataFrame, author: str, register: str, bundled: tuple[str, ...] = BUNDLED) -> DataFrame:
    """text: bundled texts and other authors' ones, copies kept."""
    own = exemplars.sparkSession.createDataFrame([(t,) for t in bundled], "text string")
    return own.unionByName(other_authors(exemplars, author, register).select("text"))


def build_profile(store: Store, author: str, register: str, version: str, built_at: str, prose_model: Callable[[str], str], impostors: DataFrame | None = None) -> dict:
    """Calibrate an author's register on its most recent exemplars, write the profile and activate it.

    Fewer than LEAST_EXEMPLARS exemplars raise InsufficientCorpusError, and nothing is written."""
    spark = store.spark
    rows = store.exemplars().where((F.col("author_id") == author) & (F.col("register") == retrieval.checked_register(register)) & F.col("is_canonical"))
    pulled = settled(retrieval.recent(rows, MOST_PULLED), "pulled")
    n = pulled.count()
    if n < LEAST_EXEMPLARS:
        raise InsufficientCorpusError(f"{author}/{register}: {n} exemplars")
    others = impostors if impostors is not None else impostors_for(store.exemplars(), author, register)
    docs = pulled.select("register", F.col("id").alias("doc_id"), "text", F.lit(1).alias("label")).unionByName(
        others.select(F.lit(register).alias("register"), F.concat(F.lit("other:"), F.monotonically_increasing_id().cast("string")).alias("doc_id"), "text", F.lit(0).alias("label"))
    )
    got = stylometry.calibrate(settled(docs, "calibration"), ["register"])
    metrics = got["metrics"].first()
    if metrics is None or not metrics.n_genuine or not metrics.n_impostor:
        raise ValueError("calibration needs texts of the author and of others")
    words = got["profile"].orderBy("word").collect()
    targets = stylometry.compute_targets(pulled, ["author_id", "register"], "authored_at").drop("author_id", "register").first().asDict(recursive=True)
    blob = {
        "register": register,
        "words": [[r.word, r.mean, r.std, r.centroid] for r in words],
        "scores": sorted(r.score for r in got["scores"].select("score").collect()),
        "metrics": {k: metrics[k] for k in ("n_genuine", "n_impostor", "roc_auc", "low_separation")},
    }
    shown = [r.text for r in retrieval.recent(pulled, PROSE_SHOWN).collect()]
    card = {"targets": targets, "prose": prose_of(shown, prose_model)}
    mean = retrieval.mean_vector(pulled, ["register"], "style_embedding").first()
    row = (author, register, version, json.dumps(card), json.dumps(blob), None if mean is None else [float(x) for x in mean.centroid], n)
    profile = spark.createDataFrame([row], "author_id string, register string, version string, style_card string, stylometric_vector string, style_centroid array<float>, exemplar_count int")
    store.write_profile(profile.withColumn("built_at", F.lit(built_at).cast("timestamp")))
    store.activate(author, register, version)
    return {"version": version, "exemplar_count": n, "readiness": "profile-grade" if n >= PROFILE_EXEMPLARS else "generation-ready", "roc_auc": metrics.roc_auc}


def judged(blob: dict, text: str, strictness: str = "normal") -> Verdict:
    """The verdict on one text by a profile: cosine-delta score, its percentile among the profile's scores, threshold."""
    tokens = re.findall(WORD, text.lower())
    seen = Counter(tokens)
    z = [((seen[w] / len(tokens) if tokens else 0.0) - mean) / std for w, mean, std, _ in blob["words"]]
    c = [x[3] for x in blob["words"]]
    norm = math.sqrt(sum(x * x for x in z)) * math.sqrt(sum(x * x for x in c))
    score = sum(x * y for x, y in zip(z, c, strict=True)) / norm if norm else 0.0
    # Scores made in other orders of summing may differ in their last digits.
    percentile = bisect_right(blob["scores"], score + 1e-9) / len(blob["scores"]) if blob["scores"] else 0.0
    limit, words = gate.THRESHOLD[strictness], len(re.findall(WORD, text))
    passed = percentile >= limit
    if words < gate.LEAST_WORDS or abs(percentile - limit) <= gate.BAND or (passed and blob["metrics"]["low_separation"]):
        return Verdict("REVIEW", percentile, passed)
    return Verdict("PASS" if passed else "FAIL", percentile, passed)


@dataclass
class Engine:
    """model: prompt to text. prose_model: prompt to JSON (model, if none). embed: text column to vector column.
    detector: text to a probability. meaning: text column to vector column for the similarity part of the meaning check."""

    store: Store
    model: Callable[[str], str]
    prose_model: Callable[[str], str] | None = None
    embed: Callable[[Column], Column] | None = None
    dim: int = 768
    detector: Callable[[str], float] | None = None
    meaning: Callable[[Column], Column] | None = None
    rhythm: Callable[[str, str], str] | None = None
    #: (voice_id, sources, corpus_ref) to the units that voice_add builds from.
    corpora: Callable[[str, list[str], str | None], DataFrame] | None = None
    jobs: Jobs = field(default_factory=Jobs)

    def _own(self, voice: str, register: str) -> DataFrame:
        return self.store.exemplars().where(F.col("author_id") == voice)

    def exemplars(self, voice: str, register: str, k: int = EXEMPLARS_SHOWN) -> list[str]:
        """The k most recent texts of a voice."""
        return [r.text for r in retrieval.retrieve(self._own(voice, register), register, k).select("text").collect()]

    def facts(self, voice: str, register: str, about: str, k: int = FACTS_SHOWN) -> list[str]:
        """The k texts of a voice whose content is nearest to a question; none without an embedder."""
        if self.embed is None:
            return []
        seed = list(self.store.spark.createDataFrame([(about,)], "text string").select(self.embed(F.col("text"))).first()[0])
        return [r.text for r in retrieval.retrieve(self._own(voice, register), register, k, content=seed).collect()]

    def profile(self, voice: str, register: str) -> dict | None:
        """The active profile with its references and readiness."""
        row = self.store.active().where((F.col("author_id") == voice) & (F.col("register") == retrieval.checked_register(register))).first()
        if row is None:
            return None
        _card(json.loads(row.style_card))
        grade = "profile-grade" if row.exemplar_count >= PROFILE_EXEMPLARS else "generation-ready"
        return {"version": row.version, "style_card": row.style_card, "blob": json.loads(row.stylometric_vector), "exemplar_pool_ref": f"{voice}:{register}", "centroid_ref": f"{voice}:{register}:{row.version}", "readiness": grade}

    def _prompt(self, card: str | None, shown: list[str], facts: list[str], task: str, nudge: str | None) -> str:
        row = self.store.spark.createDataFrame([(card, shown, facts, task, nudge)], "card string, shown array<string>, facts array<string>, task string, nudge string")
        parsed = row.withColumn("c", F.from_json("card", CARD))
        made = F.when(F.col("card").isNotNull(), assemble.style_card(F.col("c.targets"), F.col("c.prose")))
        return parsed.select(assemble.prompt(made, F.col("shown"), F.col("facts"), F.col("task"), F.col("nudge"))).first()[0]

    def _breaches(self, before: str, after: str) -> list[str]:
        row = self.store.spark.createDataFrame([(before, after)], "b string, a string")
        like = (lambda x, y: deai.cosine(self.meaning(x), self.meaning(y))) if self.meaning else None
        return list(deai.with_breaches(row, "lost", "b", "a", like).first().lost)

    def _draft(self, voice: str, register: str, task: str, strictness: str | None = None, about: str | None = None, source: str | None = None) -> dict:
        profile = self.profile(voice, register)
        level = "normal" if strictness in (None, "standard") else strictness
        shown = self.exemplars(voice, register)
        facts = self.facts(voice, register, about) if about and profile else []
        card = profile["style_card"] if profile else None
        got = generate(lambda nudge: self._prompt(card, shown, facts, task, nudge), self.model, (lambda t: judged(profile["blob"], t, level)) if profile else None)
        extras = ["meaning"] if source is not None and self._breaches(source, got.text) else []
        v = got.verdict
        row = self.store.spark.createDataFrame([(v.verdict, v.gate_a, v.percentile, v.gate_b, got.cold_start, extras)], "v string, a boolean, p double, b string, c boolean, x array<string>")
        g = row.select(gate.gate_result(*map(F.col, "vapbcx")).alias("g")).first().g
        scores = {"stylometric_similarity": g.similarity, "ai_detector_prob": g.detector_prob, "register_fit": g.register_fit}
        return {"text": got.text, "verdict": g.verdict, "scores": scores, "gate": {"passed": g.passed, "failed_checks": list(g.failed)}, "register": register, "voice_id": voice}

    def generate(self, voice_id: str, register: str, brief: str, grounding_query: str | None = None) -> dict:
        checked_input(brief, voice_id)
        return self._draft(voice_id, register, brief, about=grounding_query)

    def rewrite(self, voice_id: str, register: str, text: str, strictness: str | None = None) -> dict:
        """A text in a voice; one that loses numbers, links, addresses or names is for review."""
        checked_input(text, voice_id)
        return self._draft(voice_id, register, REWRITE + text, strictness, source=text)

    def transform(self, to_voice: str, register: str, text: str) -> dict:
        return self.rewrite(to_voice, register, text)

    def deai(self, text: str, register: str, strictness: str = "standard", voice_id: str = "") -> dict:
        """One text through the repairs, with the detector's view of it before and after."""
        checked_input(text)
        row = self.store.spark.createDataFrame([(text, retrieval.checked_register(register))], "text string, register string")
        r = deai.deai(row, strictness, rhythm=self.rhythm, embed=self.meaning).first()
        before, after = (min(1.0, max(0.0, self.detector(t))) if self.detector else 0.0 for t in (text, r.output))
        failed = [h.id for h in r.residual] + ["meaning"] * len(r.breaches)
        scores = {"stylometric_similarity": 0.0, "ai_detector_prob": after, "register_fit": 1.0}
        return {"text": r.output, "verdict": r.verdict, "scores": scores, "gate": {"passed": r.verdict == "PASS", "failed_checks": failed}, "register": register, "voice_id": voice_id, "ai_detector_prob_before": before, "ai_detector_prob_after": after}

    def build_voice(self, voice_id: str, units: DataFrame, version: Callable[[str], str], built_at: str) -> dict:
        """Ingest units, store them, and build a profile for each of their registers; thin registers are skipped."""
        records = settled(ingest(units), "records")
        self.store.upsert(records, self.embed, self.dim)
        found = {r.register: r.n for r in records.where("is_canonical").groupBy("register").agg(F.min("timestamp").alias("first"), F.count("*").alias("n")).orderBy("first", "register").collect()}
        # Thinness is judged on what the store holds, which may be more than these units.
        built, skipped = build_registers({r: LEAST_EXEMPLARS for r in found}, lambda r: build_profile(self.store, voice_id, r, version(r), built_at, self.prose_model or self.model))
        return {"ingested": records.count(), "built_registers": built, "skipped_registers": skipped}

    def add_voice(self, voice_id: str, units: DataFrame, version: Callable[[str], str], built_at: str) -> str:
        """Start build_voice in the background; returns the job's id."""
        checked_input(voice_id=voice_id)
        return self.jobs.start(lambda: self.build_voice(voice_id, units, version, built_at))[0]

    def add_from(self, voice_id: str, sources: list[str], corpus_ref: str | None = None) -> str:
        """add_voice from what the injected corpora give, versions and time by the clock."""
        if self.corpora is None:
            raise RuntimeError("no corpora are connected")
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        return self.add_voice(voice_id, self.corpora(voice_id, sources, corpus_ref), lambda register: f"{register}-{now}", now)

    def list_voices(self) -> DataFrame:
        return voices(self.store.active())

    def voice_status(self, voice_id: str) -> DataFrame:
        """The three registers of a voice, also of one that has nothing yet."""
        author = self.store.spark.createDataFrame([(voice_id,)], "author_id string")
        mine = F.col("author_id") == voice_id
        return status(author, self.store.active().where(mine), self.store.exemplars().where(mine))
