"""Segmentation and span search that need a cursor over the text: Arrow-batched functions and table functions.

Offsets are code points, from 0, half open. A null text has no chunks, segments or spans.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
SEGMENT = "array<struct<start:int,end:int,text:string,kind:string>>"

# The terminal signs, the connectives and the negations that results depend on.
_TERMINAL = re.compile(r"[.!?]+[\"'’”)}\]]*\s+")
CONNECTIVES = ("because", "but", "so", "then", "when", "whenever", "once", "if", "unless", "until", "while", "after", "before", "although", "however")
NEGATED_BEFORE = frozenset(("not", "never", "nothing", "cannot", "cant", "without"))
NEGATED_AFTER = frozenset(("no", "nothing", "nobody", "none"))

_CONNECTIVE = re.compile(rf"\s+(?=(?:{'|'.join(CONNECTIVES)})\b)", re.I)
_WORD = re.compile(r"\S+")
_LETTERS = re.compile("[A-Za-z]{4,}")


def char_chunks(text: str | None, size: int = 10_000, back: int = 200) -> list[tuple[int, int, str]]:
    """Pieces of at most ``size`` characters, cut after a sentence within the last ``back``, else at a space, else hard."""
    out, at = [], 0
    text = text or ""
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            low = max(at + 1, end - back)
            stops = [text.rfind(s, low, end) for s in (". ", "! ", "? ", ".\n")]
            cut = max(stops)
            if cut >= 0:
                end = cut + 1
            elif (space := text.rfind(" ", low, end)) > 0:
                end = space
        piece = text[at:end]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + lead + len(piece.strip()), piece.strip()))
        at = end
    return out


def halves(text: str | None, fits, least: int = 2000, depth: int = 2) -> list[str]:
    """The text, or its halves near the middle space, as often as ``fits`` refuses, ``depth`` times at most."""
    text = text or ""
    if depth == 0 or len(text) < least or fits(text):
        return [text]
    middle = len(text) // 2
    left, right = text.rfind(" ", 0, middle), text.find(" ", middle)
    cut = left if left > 0 and (right < 0 or middle - left <= right - middle) else right if right > 0 else middle
    return halves(text[:cut].strip(), fits, least, depth - 1) + halves(text[cut:].strip(), fits, least, depth - 1)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    part = text[start:end]
    if not part.strip():
        return None
    return start + len(part) - len(part.lstrip()), end - (len(part) - len(part.rstrip()))


def sentences(text: str) -> list[tuple[int, int]]:
    """The stretches between terminal signs that white space follows, the signs and closing marks with what they end."""
    return _parts(text, 0, len(text), (m.end() for m in _TERMINAL.finditer(text)))


def _parts(text: str, start: int, end: int, cuts: Iterable[int]) -> list[tuple[int, int]]:
    """What lies between the cuts, without outer white space; blank parts drop out."""
    edges = [start, *cuts, end]
    return [span for a, b in zip(edges, edges[1:], strict=False) if (span := _trimmed(text, a, b))]


def segments(text: str | None, most: int = 32) -> list[tuple[int, int, str, str]]:
    """Sentences, cut before connectives; a part of more than ``most`` words goes into runs of so many.

    The kind is sentence for an uncut one, discourse for a part of one, fallback for a run.
    """
    text, out = text or "", []
    for a, b in sentences(text):
        parts = _parts(text, a, b, (m.start() for m in _CONNECTIVE.finditer(text, a, b)))
        for lo, hi in parts:
            words = [m.span() for m in _WORD.finditer(text, lo, hi)]
            if len(words) <= most:
                out.append((lo, hi, text[lo:hi], "sentence" if len(parts) == 1 else "discourse"))
            else:
                runs = (words[k : k + most] for k in range(0, len(words), most))
                out += [(r[0][0], r[-1][1], text[r[0][0] : r[-1][1]], "fallback") for r in runs]
    return out


def clause_windows(text: str | None, size: int = 32, stride: int = 16, most: int = 20) -> list[tuple[int, int, str]]:
    """Segments as clause candidates; long sentences as overlapping word windows, the last one included; evenly ``most``."""
    text, spans = text or "", []
    for a, b in sentences(text):
        words = [(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])]
        if len(words) <= size:
            spans.append((a, b))
        else:
            starts = [*range(0, len(words) - size, stride), len(words) - size]
            spans += [(words[k][0], words[k + size - 1][1]) for k in starts]
    spans = list(dict.fromkeys(spans))
    if len(spans) > most:
        spans = [spans[i] for i in dict.fromkeys(round(k * (len(spans) - 1) / (most - 1)) for k in range(most))]
    return [(a, b, text[a:b]) for a, b in spans]


def bounded_spans(text: str | None, phrase: str | None, possessive: bool = False) -> list[tuple[int, int, str]]:
    """All places of a phrase between other than word characters, overlapping ones included; case doesn't matter."""
    if not text or not phrase:
        return []
    tail = r"(?:['’]s)?" if possessive else ""
    pattern = re.compile(rf"(?<![A-Za-z0-9])(?=({re.escape(phrase)}{tail})(?![A-Za-z0-9]))", re.I)
    return [(m.start(1), m.end(1), m[1]) for m in pattern.finditer(text)]


def literal_spans(text: str | None, wanted: str | None) -> list[tuple[int, int, str]]:
    """All places of a text, white space in it matching any white space, case aside."""
    words = (wanted or "").split()
    if not text or not words:
        return []
    pattern = re.compile(r"\s+".join(map(re.escape, words)), re.I)
    return [(m.start(), m.end(), m[0]) for m in pattern.finditer(text)]


@lru_cache(maxsize=200_000)
def _likest(word: str, names: tuple[str, ...], least: float) -> tuple[float, str]:
    """The name most like a word, of about its length; names whose letters alone can't reach ``least`` are passed over."""
    found = [(0.0, "")]
    for n in names:
        if abs(len(n) - len(word)) <= 3:
            m = difflib.SequenceMatcher(None, word, n.lower())
            if m.quick_ratio() >= least:
                found.append((m.ratio(), n))
    return max(found)


def fuzzy_names(text: str | None, names: tuple[str, ...], ratio: float = 0.84) -> list[tuple[int, int, str]]:
    """Names in a text by place: exact ones first, longest first and not inside each other; other words by likeness."""
    text = text or ""
    found: list[tuple[int, int, str]] = []
    low, sizes = text.lower(), {len(n) + d for n in names for d in range(-3, 4)}
    for n in sorted(names, key=lambda n: (-len(n), n)):
        for a, b, _ in bounded_spans(text, n) if n.lower() in low else ():
            if not any(a < y and x < b for x, y, _ in found):
                found.append((a, b, n))
    for m in _LETTERS.finditer(text):
        if m.end() - m.start() in sizes and not any(m.start() < y and x < m.end() for x, y, _ in found):
            best = _likest(m[0].lower(), names, ratio)
            if best[0] >= ratio:
                found.append((m.start(), m.end(), best[1]))
    return sorted(found)


_TOKEN = re.compile("[a-z0-9]+")


def negated_near(text: str | None, phrase: str) -> bool:
    """Whether a negation stands near some occurrence of the phrase between other than letters and digits.

    One list counts among the last four words of the 48 characters before it, another among the first two of the 24 after.
    """
    for a, b, _ in bounded_spans(text, phrase):
        before, after = _TOKEN.findall(text[max(0, a - 48) : a].lower()), _TOKEN.findall(text[b : b + 24].lower())
        if NEGATED_BEFORE.intersection(before[-4:]) or NEGATED_AFTER.intersection(after[:2]):
            return True
    return False


def strict_object(raw: str | None, keys: frozenset[str]) -> str | None:
    """A JSON object with exactly these keys, no key twice, perhaps inside one code fence; anything else is null."""

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    body = re.fullmatch(r"\s*```(?:json)?\s*\n(.*?)\n\s*```\s*", raw or "", re.S)
    try:
        found = json.loads(body[1] if body else raw or "", object_pairs_hook=once)
    except ValueError:
        return None
    return json.dumps(found, sort_keys=True) if isinstance(found, dict) and set(found) == keys else None


def lenient_items(raw: str | None) -> list[str]:
    """Texts out of what a model wrote: a fenced or embedded JSON object or list; strings, or objects with a text."""
    body = re.sub(r"```(?:json)?", "", raw or "")
    found = None
    embedded = [m for p in (r"\{.*\}", r"\[.*\]") if (m := re.search(p, body, re.S))]
    for candidate in (body, *(m[0] for m in sorted(embedded, key=lambda m: m.start()))):
        try:
            found = json.loads(candidate)
            break
        except ValueError:
            continue
    values = [x for v in found.values() for x in (v if isinstance(v, list) else [v])] if isinstance(found, dict) else found if isinstance(found, list) else []
    texts = [v.get("text") if isinstance(v, dict) else v for v in values]
    return [t.strip() for t in texts if isinstance(t, str) and t.strip()]


def _spans(f, schema: str, *extra):
    """A pandas function from texts to arrays of structs."""
    names = [p.split(":")[0] for p in schema[len("array<struct<") : -2].split(",")]

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(names, row, strict=True)) for row in f(t, *extra)], na_action=None)

    return run


def chunked(text: Column, size: int = 10_000, back: int = 200) -> Column:
    return _spans(char_chunks, SPAN, size, back)(text)


def segmented(text: Column, most: int = 32) -> Column:
    return _spans(segments, SEGMENT, most)(text)


def clauses(text: Column, size: int = 32, stride: int = 16, most: int = 20) -> Column:
    return _spans(clause_windows, SPAN, size, stride, most)(text)


def phrase_spans(text: Column, phrase: str, possessive: bool = False) -> Column:
    return _spans(bounded_spans, SPAN, phrase, possessive)(text)


def fuzzy(text: Column, names: tuple[str, ...], ratio: float = 0.84) -> Column:
    return _spans(fuzzy_names, SPAN, names, ratio)(text)


def find_spans(text: Column, wanted: Column) -> Column:
    """Places of one column's text in another's."""

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "text": t} for a, b, t in literal_spans(x, y)] for x, y in zip(texts, others, strict=True)])

    return run(text, wanted)
