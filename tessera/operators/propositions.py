"""Propositions out of packets of sources, stage by stage, from a model's closed answers.

A packet has sources (kind to text) and candidate clauses (id, kind, start, end). The model is asked for one thing at a
time: which one or two candidates bear the claim; the exact phrases of actor, event, effect and condition; which way the
claim runs; which terms of the vocabularies it falls under. Every answer is a JSON object with exactly the keys asked for.
Offsets are always found here, never taken from an answer, and whatever can't be placed fails the packet with the name of
its stage: nothing is guessed, and a failure never fails a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import spans as S

# The slots of a claim in the order in which they are asked for, and the ways that a claim may run.
SLOTS = ("actor", "event", "effect", "condition")
DIRECTIONS = ("actor_event_causes_effect", "effect_causes_actor_event", "association_only", "temporal_sequence_only", "insufficient_causal_claim")
TERMS = ("actor_concept", "event_relation", "effect_concept")
MOST_CANDIDATES = 2

Span = tuple[int, int]


class Refused(ValueError):
    """An answer that can't be used; the message is its code."""


def closed(raw: str | None, *keys: str) -> dict:
    found = S.strict_object(raw, frozenset(keys))
    if found is None:
        raise Refused("shape")
    return json.loads(found)


def coalesced(spans: list[Span], text: str) -> list[Span]:
    """Spans in order; those that overlap, touch, or have white space alone between them become one."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and not text[out[-1][1] : a].strip() and (a <= out[-1][1] or text[out[-1][1] : a].isspace()):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def evidence(raw: str | None, sources: dict[str, str], candidates: dict[str, tuple[str, int, int]]) -> tuple[str | None, list[Span]]:
    """The source and the spans that bear the claim; (None, []) where the model says that nothing does."""
    body = closed(raw, "source", "candidate_ids")
    kind, ids = body["source"], body["candidate_ids"]
    if kind is None and ids == []:
        return None, []
    if not isinstance(kind, str) or kind not in sources:
        raise Refused("source")
    if not isinstance(ids, list) or not 1 <= len(ids) <= MOST_CANDIDATES or not all(isinstance(i, str) and i for i in ids):
        raise Refused("count")
    if len(set(ids)) < len(ids):
        raise Refused("twice")
    if any(i not in candidates for i in ids):
        raise Refused("unknown")
    if any(candidates[i][0] != kind for i in ids):
        raise Refused("mixed")
    return kind, coalesced([candidates[i][1:] for i in ids], sources[kind])


def located(phrase: str, text: str, spans: list[Span]) -> Span:
    """The one place of an exact phrase inside the spans; elsewhere in the text it may stand as often as it likes."""
    phrase, found, at = phrase.strip(), [], -1
    while phrase and (at := text.find(phrase, at + 1)) >= 0:
        edge = lambda k: 0 <= k < len(text) and text[k].isalnum()
        whole = not (edge(at - 1) and phrase[0].isalnum()) and not (edge(at + len(phrase)) and phrase[-1].isalnum())
        if whole and any(a <= at and at + len(phrase) <= b for a, b in spans):
            found.append((at, at + len(phrase)))
    if len(found) != 1:
        raise Refused("outside" if not found else "ambiguous")
    return found[0]


def slot(raw: str | None, role: str, text: str, spans: list[Span]) -> Span | None:
    """Where a slot's phrase stands; a condition may be absent."""
    phrase = closed(raw, role)[role]
    if role == "condition" and phrase in (None, "NONE"):
        return None
    if not isinstance(phrase, str) or not phrase.strip():
        raise Refused("phrase")
    return located(phrase, text, spans)


def direction(raw: str | None) -> str:
    found = closed(raw, "causal_direction")["causal_direction"]
    if found not in DIRECTIONS:
        raise Refused("label")
    return found


def normalised(raw: str | None, concepts: frozenset[str], relations: frozenset[str]) -> tuple[str | None, ...]:
    """Terms of the vocabularies, or null; a term that isn't listed is invented and refused."""
    body = closed(raw, *TERMS)
    values = tuple(body[k] for k in TERMS)
    if not all(v is None or isinstance(v, str) for v in values):
        raise Refused("type")
    if any(v is not None and v not in allowed for v, allowed in zip(values, (concepts, relations, concepts), strict=True)):
        raise Refused("invented")
    return values


def proposition(chat: Callable[[str, dict], str], sources: dict[str, str], candidates: dict[str, tuple[str, int, int]], concepts: frozenset[str], relations: frozenset[str]) -> dict:
    """One packet through all stages: stage, code, the slots' phrases and starts, and the terms.

    stage is "assembled", or "abstained" where nothing bears a claim or it doesn't run from actor to effect, or the stage
    that refused, with its code. ``chat`` gets the stage's name and what it may look at.
    """
    out, stage = {}, "evidence"
    try:
        kind, spans = evidence(chat("evidence", {"sources": sources, "candidates": candidates}), sources, candidates)
        if kind is None:
            return {"stage": "abstained", "code": "none"}
        text = sources[kind]
        shown = [text[a:b] for a, b in spans]
        for stage in SLOTS:
            if (place := slot(chat(stage, {"evidence": shown}), stage, text, spans)) is not None:
                out |= {stage: text[place[0] : place[1]], f"{stage}_start": place[0]}
        stage = "direction"
        if (way := direction(chat(stage, {"evidence": shown}))) != DIRECTIONS[0]:
            return {"stage": "abstained", "code": way}
        stage = "normalization"
        out |= dict(zip(TERMS, normalised(chat(stage, {k: out.get(k) for k in SLOTS}), concepts, relations), strict=True))
    except Refused as e:
        return {"stage": stage, "code": str(e)}
    return {"stage": "assembled", "code": kind} | out


RESULT = "struct<stage:string,code:string," + ",".join(f"{s}:string,{s}_start:int" for s in SLOTS) + "," + ",".join(f"{t}:string" for t in TERMS) + ">"


def propositions(packets: DataFrame, chat: Callable[[str, dict], str], concepts: tuple[str, ...], relations: tuple[str, ...]) -> DataFrame:
    """id and what ``proposition`` finds, for packets of id, sources (map of kind to text) and candidates (array of structs
    of id, kind, start and end). An error of the callable is an answer that can't be used."""
    allowed, verbs = frozenset(concepts), frozenset(relations)

    def safe(stage: str, shown: dict) -> str | None:
        try:
            return chat(stage, shown)
        except Exception:  # noqa: BLE001
            return None

    def run(sources: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        rows = [proposition(safe, dict(s), {c["id"]: (c["kind"], int(c["start"]), int(c["end"])) for c in found}, allowed, verbs) for s, found in zip(sources, candidates, strict=True)]
        names = ["stage", "code", *(n for s in SLOTS for n in (s, f"{s}_start")), *TERMS]
        frame = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
        return frame.astype({f"{s}_start": "Int32" for s in SLOTS})

    return packets.select("id", F.pandas_udf(run, RESULT)("sources", "candidates").alias("p")).select("id", "p.*")
