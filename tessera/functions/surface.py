"""Flags and hints of all runs of words of a window, from one look at each distinct word.

What ``cues.surface_flags`` and ``cues.type_hints`` say of a phrase follows from its words: a word's facts are bits, and a
run's are those of its words put together. Words are looked up once a batch or less, runs are shifts of arrays.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

from tessera.functions import cues

LISTS = (cues.PRONOUNS, cues.RESOURCES, cues.ACTIONS, cues.EVENTS, cues.MODALS, cues.NEGATIONS, cues.CONDITIONS, cues.CAUSES, cues.TIMES, cues.FILLERS)
FLAGS = (
    "starts_with_uppercase all_caps_word ends_with_ing ends_with_ed ends_with_s has_apostrophe_s has_hyphen is_single_token cue_pronoun cue_ability_alias cue_action cue_event cue_modal "
    "cue_negation cue_conditional cue_causal cue_temporal cue_filler cue_disfluency has_quote"
).split()
TYPES = ("ENTITY", "ABILITY_OR_RESOURCE", "ACTION", "EVENT", "STATE", "TIME", "LOCATION_OR_SPACE", "QUANTITY")
#: Distinct words whose facts a task keeps.
KNOWN = 500_000
_SIGNS = frozenset("_'’%-")
#: The halves of two-word hesitations, which match within words.
_HALVES = tuple(h.split(" ") for h in cues.HESITATIONS)
# Facts of a word that hold for a run if they hold for any of its words.
APOSTROPHE, HYPHEN, QUOTE, PLAIN, DISFLUENT, SOME = (1 << k for k in range(6))
LISTED = 6  # from this bit on, one for each list
# Facts that count at the first or the last word, or in pairs of neighbours.
UPPER, ING, ED, S, ONE = (1 << k for k in range(16, 21))
LEFT, RIGHT = 21, 27  # from these bits on, one for each half


_ASCII = re.compile("[A-Za-z0-9][A-Za-z0-9_'%-]*")


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _number(c: str) -> bool:
    return unicodedata.category(c)[0] == "N"


def parts(token: str) -> list[str]:
    """The words of ``cues.WORD`` in a text without spaces."""
    if token.isascii():
        return _ASCII.findall(token)
    out, at = [], None
    for i, c in enumerate(token):
        body = _letter(c) or _number(c)
        if at is None and body:
            at = i
        elif at is not None and not body and c not in _SIGNS:
            out.append(token[at:i])
            at = None
    return out if at is None else [*out, token[at:]]


def _possessive(low: str) -> bool:
    """An apostrophe and s that neither a letter, a digit nor an underscore follows."""
    for i in range(len(low) - 1):
        if low[i] in "'’" and low[i + 1] == "s" and (i + 2 == len(low) or not (_letter(low[i + 2]) or _number(low[i + 2]) or low[i + 2] == "_")):
            return True
    return False


def facts(token: str) -> int:
    """The facts of a word as it stands, as bits."""
    words = parts(token)
    low = [w.lower() for w in words]
    bits = 0 if token.isalpha() else APOSTROPHE * _possessive(token.lower()) | HYPHEN * ("-" in token) | QUOTE * ('"' in token or "'" in token)
    if not words:
        return bits
    for w in low:
        bits |= _LISTED.get(w, 0)
    capital = all(w == w.upper() and w.lower() != w and all(map(_letter, w)) for w in words)
    inner = len(low) > 1 and any(a.endswith(x) and b.startswith(y) for a, b in zip(low, low[1:], strict=False) for x, y in _HALVES)
    bits |= SOME | PLAIN * (not capital) | DISFLUENT * inner | UPPER * (unicodedata.category(words[0][0]) == "Lu") | ONE * (len(words) == 1)
    bits |= ING * low[-1].endswith("ing") | ED * low[-1].endswith("ed") | S * low[-1].endswith("s")
    if low[-1].endswith(_LEFTS) or low[0].startswith(_RIGHTS):
        for k, (x, y) in enumerate(_HALVES):
            bits |= low[-1].endswith(x) << (LEFT + k) | low[0].startswith(y) << (RIGHT + k)
    return bits


_SETS = tuple(map(frozenset, LISTS))
_LISTED = {w: sum(1 << (LISTED + k) for k, listed in enumerate(_SETS) if w in listed) for w in frozenset().union(*LISTS)}
_LEFTS, _RIGHTS = (tuple(h[k] for h in _HALVES) for k in (0, 1))
_EVENTS, _STATES, _PLACES, _CONDITIONS = map(frozenset, (cues.EVENTS, cues.NEGATIONS + cues.MODALS, cues.PLACES, cues.CONDITIONS))


def _decimal(w: str) -> bool:
    if w.isalpha():
        return False
    w = w.removesuffix("%")
    return bool(w) and all(unicodedata.category(c) == "Nd" for c in w)


def hints(token: str) -> int:
    """The type hints of a word as it stands, a bit each in the order of ``TYPES``."""
    low = [w.lower().replace("’", "'") for w in parts(token)]
    has = lambda listed: not listed.isdisjoint(low)
    conditional = has(_CONDITIONS)
    upper = not token.islower() and any(unicodedata.category(c) == "Lu" and (i == 0 or token[i - 1] in " \t\n\x0b\f\r") for i, c in enumerate(token))
    rules = (
        has(_SETS[0]) or upper, has(_SETS[1]), has(_SETS[2]), has(_EVENTS) or conditional or any(w.endswith(("ed", "ing")) for w in low),
        has(_STATES) or conditional, has(_SETS[8]) or conditional, has(_PLACES), any(map(_decimal, low)),
    )
    return sum(1 << k for k, rule in enumerate(rules) if rule)


def looked_up(words: pa.Array, known: dict[str, int], of) -> np.ndarray:
    """``of`` each word of a column, each distinct one once; ``known`` keeps what it said."""
    d = words.dictionary_encode()
    if len(known) > KNOWN:
        known.clear()
    found = []
    for w in d.dictionary.to_pylist():
        if (bits := known.get(w)) is None:
            bits = known[w] = of(w)
        found.append(bits)
    return np.array(found, np.int64)[d.indices.to_numpy()] if found else np.zeros(0, np.int64)


def runs(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of n words: row, first word (from 0) and size of all runs of up to ``most``, by row, start and size."""
    row, first = np.repeat(np.arange(len(n)), n), n.cumsum() - n
    start = np.arange(n.sum()) - first[row]
    sizes = np.minimum(most, n[row] - start)
    each = np.repeat(np.arange(len(row)), sizes)
    return row[each], start[each], np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes) + 1


def run_flags(bits: np.ndarray, at: np.ndarray, size: np.ndarray, most: int) -> dict[str, np.ndarray]:
    """The surface flags of runs of words: ``at`` is a run's first word among all ``bits``."""
    every, pairs = bits[at], np.zeros(len(at), bool)
    head = last = every
    count = np.where(every & ONE, 1, np.where(every & SOME, 2, 0))
    for k in range(1, most):
        more = size > k
        b = np.where(more, bits[np.minimum(at + k, len(bits) - 1)], 0)
        some = (b & SOME) > 0
        # Words without a word in them stand between none.
        pairs |= ((last >> LEFT) & (b >> RIGHT) & 63 > 0) & some & ((last & SOME) > 0)
        count = count + np.where(b & ONE, 1, np.where(some, 2, 0))
        head, last, every = np.where((head & SOME) > 0, head, np.where(some, b, head)), np.where(some, b, last), every | b
    listed = lambda k: (every >> (LISTED + k)) & 1 > 0
    has = lambda x, bit: (x & bit) > 0
    found = [has(head, UPPER), has(every, SOME) & ~has(every, PLAIN), has(last, ING), has(last, ED), has(last, S), has(every, APOSTROPHE), has(every, HYPHEN), count == 1]
    found += [listed(k) for k in range(len(LISTS))]
    return dict(zip(FLAGS, [*found, has(every, DISFLUENT) | pairs | listed(9), has(every, QUOTE)], strict=True))


def run_hints(bits: np.ndarray, at: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """The hints of runs of words, as bits."""
    every = bits[at]
    for k in range(1, most):
        every = every | np.where(size > k, bits[np.minimum(at + k, len(bits) - 1)], 0)
    return every


#: The hints of each set of bits, joined by commas.
HINTS = pa.array([",".join(name for k, name in enumerate(TYPES) if bits >> k & 1) for bits in range(1 << len(TYPES))])
