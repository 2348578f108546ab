"""Cues on the surface of a span: word lists, flags, type hints, and the values that a qualifier's cue allows.

All are column functions that stay in the JVM. Words here are runs of letters, digits and ``_ ' ’ % -`` that begin with a
letter or digit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lists that features and hints rest on.
PRONOUNS = "i me my mine we us our ours you your yours he him his she her hers it its they them their theirs this that these those".split()
RESOURCES = "q w e r ult ultimate flash teleport tp ignite exhaust heal barrier cleanse smite mana energy health hp cooldown charge charges stack stacks wave vision ward wards sweeper trinket item items".split()
ACTIONS = "answer attack back base buy catch chase contest crash die dive engage farm fight flank freeze hit hook jump kill move peel portal push recall respect roam rotate run save spend step stop trade walk ward".split()
EVENTS = "arrive become begins comes ends expires fail fails lands miss missed misses resets returns spent starts used wastes".split()
TIMES = "after before during first later once then until when whenever while".split()
CONDITIONS = "if unless only whenever when while once after before".split()
NEGATIONS = "no not never neither nor can't cant cannot couldn't couldnt doesn't doesnt don't dont won't wont unable without".split()
MODALS = "can could may might must should usually sometimes would".split()
PLACES = "baron base bot bush bushes dragon jungle lane mid river side tower top".split()
CAUSES = "because so thus therefore since hence consequently as".split()
FILLERS = "like um uh yeah yep right okay ok well actually basically literally kind sort maybe perhaps just really very".split()
HESITATIONS = ("you know", "i mean", "kind of", "sort of", "i think", "i guess")

WORD = r"[\p{L}\p{N}][\p{L}\p{N}_'’%-]*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def _has(row: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(row, F.array(*[F.lit(w) for w in listed]))


def surface_flags(text: Column, row: Column, low: Column) -> dict[str, Column]:
    """Twenty flags of a span by name; ``row`` holds its words, ``low`` the same in lower case."""
    last = F.coalesce(F.try_element_at(low, F.lit(-1)), F.lit(""))
    joined = F.array_join(low, " ")
    capital = lambda w: (w == F.upper(w)) & (F.lower(w) != w) & w.rlike(r"^\p{L}+$")
    return {
        "starts_with_uppercase": F.coalesce(F.get(row, F.lit(0)), F.lit("")).rlike(r"^\p{Lu}"),
        "all_caps_word": (F.size(row) > 0) & F.forall(row, capital),
        "ends_with_ing": last.endswith("ing"),
        "ends_with_ed": last.endswith("ed"),
        "ends_with_s": last.endswith("s"),
        "has_apostrophe_s": F.lower(text).rlike(r"['’]s($|[^\p{L}\p{N}_])"),
        "has_hyphen": text.contains("-"),
        "is_single_token": F.size(row) == 1,
        "cue_pronoun": _has(low, PRONOUNS),
        "cue_ability_alias": _has(low, RESOURCES),
        "cue_action": _has(low, ACTIONS),
        "cue_event": _has(low, EVENTS),
        "cue_modal": _has(low, MODALS),
        "cue_negation": _has(low, NEGATIONS),
        "cue_conditional": _has(low, CONDITIONS),
        "cue_causal": _has(low, CAUSES),
        "cue_temporal": _has(low, TIMES),
        "cue_filler": _has(low, FILLERS),
        "cue_disfluency": reduce(lambda a, b: a | b, [joined.contains(h) for h in HESITATIONS]) | _has(low, FILLERS),
        "has_quote": text.contains('"') | text.contains("'"),
    }


def type_hints(text: Column, low: Column) -> Column:
    """The types that a span's words point to, in order; none means any. ``low``: its words in lower case, ’ as '."""
    conditional = _has(low, CONDITIONS)
    rules = {
        "ENTITY": _has(low, PRONOUNS) | text.rlike(r"(^|\s)\p{Lu}"),
        "ABILITY_OR_RESOURCE": _has(low, RESOURCES),
        "ACTION": _has(low, ACTIONS),
        "EVENT": _has(low, EVENTS) | F.exists(low, lambda w: w.rlike("(ed|ing)$")) | conditional,
        "STATE": _has(low, NEGATIONS + MODALS) | conditional,
        "TIME": _has(low, TIMES) | conditional,
        "LOCATION_OR_SPACE": _has(low, PLACES),
        "QUANTITY": F.exists(low, lambda w: w.rlike(r"^\p{Nd}+$|^\p{Nd}+([.]\p{Nd}+)?%$")),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


# Kinds of qualifiers, patterns that a cue's whole text or a word in it fits, and the values it then allows.
QUALIFIERS = (
    ("POLARITY", ".*", ("NEGATIVE",)),
    ("CONDITIONALITY", ".*", ("CONDITIONAL", "HYPOTHETICAL", "COUNTERFACTUAL")),
    ("RESTRICTION", "not only", ("ADDITIVE",)),
    ("RESTRICTION", ".*", ("EXCLUSIVE",)),
    ("MODALITY", r".*\b(must|has to|have to|had to|needs? to|mustn't|needn't)\b.*", ("NECESSARY", "OBLIGATORY")),
    ("MODALITY", r".*\b(should|shouldn't|ought to)\b.*", ("OBLIGATORY",)),
    ("MODALITY", r".*\b(would|wouldn't)\b.*", ("POSSIBLE", "COUNTERFACTUAL")),
    ("MODALITY", r".*\b(probably|likely)\b.*", ("PROBABLE",)),
    ("MODALITY", r".*\b(will|won't|wont|shall)\b.*", ("ASSERTED",)),
    ("MODALITY", ".*", ("POSSIBLE",)),
    ("TEMPORAL_SCOPE", "always|never|usually|sometimes|often|rarely", ("HABITUAL",)),
    ("TEMPORAL_SCOPE", "currently|now", ("PRESENT",)),
    ("TEMPORAL_SCOPE", "later|will|won't|wont", ("FUTURE",)),
    ("TEMPORAL_SCOPE", "earlier|previously|already", ("PAST",)),
    ("TEMPORAL_SCOPE", "still|since|while", ("ONGOING", "BOUNDED")),
    ("TEMPORAL_SCOPE", ".*", ("BOUNDED",)),
    ("COMPARATIVE_DEGREE", "same|equal", ("EQUAL",)),
    ("COMPARATIVE_DEGREE", "most|best|highest|longest|fastest|closest|farthest", ("MAXIMUM",)),
    ("COMPARATIVE_DEGREE", "least|worst|lowest|shortest|slowest", ("MINIMUM",)),
    ("COMPARATIVE_DEGREE", "less|fewer|worse|lower|shorter|slower", ("LESS",)),
    ("COMPARATIVE_DEGREE", "than", ("GREATER", "LESS")),
    ("COMPARATIVE_DEGREE", ".*", ("GREATER",)),
    ("UNCERTAINTY", "probably|likely|usually", ("LIKELY",)),
    ("UNCERTAINTY", "maybe|perhaps|may|might|could", ("POSSIBLE",)),
    ("UNCERTAINTY", ".*", ("UNCERTAIN",)),
)


def allowed_values(kind: Column, text: Column) -> Column:
    """The values that a qualifier's cue allows, by the first pattern of its kind that fits; null for other kinds."""
    low = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    fits = [F.when((kind == k) & low.rlike(f"(?s)^({p})$"), F.array(*[F.lit(v) for v in values])) for k, p, values in QUALIFIERS]
    return F.coalesce(*fits)
