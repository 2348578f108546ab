"""Column functions on text; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of normalised keys.
NOT_WORD = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, in order; null as none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def name_key(name: Column) -> Column:
    """Lower case, letters, digits and spaces only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""))


def normalized_key(value: Column) -> Column:
    """Lower case, every other run as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(value), NOT_WORD, " "))


def spoken_key(value: Column) -> Column:
    """Like ``normalized_key``, with possessives dropped and apostrophes closed up first."""
    closed = F.regexp_replace(F.regexp_replace(F.lower(value), "['’]s\\b", ""), "['’]", "")
    return F.trim(F.regexp_replace(closed, NOT_WORD, " "))


def meaningful(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct tokens longer than two that aren't in the stop list."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*stop)))


def non_empty(*columns: Column) -> Column:
    """The first column that holds more than white space, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def strip_html(html: Column) -> Column:
    """Breaks as spaces, tags removed, the usual entities decoded, white space collapsed."""
    text = F.regexp_replace(html, "(?i)<br */?>", " ")
    text = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def tags_by_rule(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The tags, in rule order, of which some synonym occurs in the lower-cased text."""
    low = F.lower(text)
    hits = [F.when(reduce(lambda a, b: a | b, [low.contains(s) for s in synonyms]), F.lit(tag)) for tag, synonyms in rules.items()]
    return F.array_compact(F.array(*hits))


def prioritized(tags: Column, first: tuple[str, ...], most: int) -> Column:
    """Tags of the priority list in its order, then the others in theirs, at most so many."""
    wanted = F.array(*[F.lit(t) for t in first])
    return F.slice(F.concat(F.array_intersect(wanted, tags), F.array_except(tags, wanted)), 1, most)


def name_variants(name: Column) -> Column:
    """The ways a name is written: as it is, without apostrophes, dots, any signs, or spaces."""
    low = F.lower(name)
    bare = F.regexp_replace(low, "[^a-z0-9 ]", "")
    return F.array_distinct(F.array(low, F.regexp_replace(low, "['’]", ""), F.regexp_replace(low, "\\.", ""), bare, F.regexp_replace(bare, " ", "")))


def correct_names(text: Column, corrections: dict[str, str]) -> Column:
    """Replaces word-bounded misspellings, longer ones first."""
    for wrong in sorted(corrections, key=lambda w: (-len(w), w)):
        text = F.regexp_replace(text, rf"(?i)\b{_quoted(wrong)}\b", corrections[wrong])
    return text


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in literal)


def mentioned(text: Column, names: tuple[str, ...]) -> Column:
    """The names that stand in the text between other than letters and digits, in list order."""
    if all(n and all(c in "abcdefghijklmnopqrstuvwxyz0123456789" for c in n) for n in names):  # such names are tokens
        return F.array_intersect(F.array(*[F.lit(n) for n in dict.fromkeys(names)]), tokens(text))
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"(^|[^a-z0-9]){_quoted(n.lower())}($|[^a-z0-9])"), F.lit(n)) for n in names]))


def token_chunks(text: Column, size: int) -> Column:
    """The tokens of a text in consecutive runs of ``size`` (the last may be shorter), each joined by spaces.

    One pass over the text; windows made so don't carry the whole text with them.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.regexp_extract_all(plain, F.lit(f"(?:[^ ]+ ?){{1,{size}}}"), F.lit(0))


def chunk_starts(n: Column, size: int, stride: int) -> Column:
    """Starts of windows of ``size`` over n items, each ``stride`` on; one window at least."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), n - size), F.lit(stride))


def context_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of overlapping windows: another follows until one reaches the end."""
    step = size - overlap
    return F.sequence(F.lit(0), (F.ceil(F.greatest(F.lit(0), n - size) / step) * step).cast("int"), F.lit(step))


def summary(text: Column, most: int) -> Column:
    """The first sentence; if longer than ``most``, cut at a word and closed with an ellipsis."""
    first = F.regexp_extract(F.trim(text), r"^([^.!?]*[.!?]?)", 1)
    cut = F.regexp_replace(F.substring(first, 1, most), r"\s+\S*$", "")
    return F.when(F.length(first) <= most, first).otherwise(F.concat(cut, F.lit("…")))


def head_token(row: Column, function_words: tuple[str, ...]) -> Column:
    """The last token that isn't a function word, else the last token."""
    content = F.filter(row, lambda t: ~t.isin(*function_words))
    return F.when(F.size(content) > 0, F.element_at(content, -1)).when(F.size(row) > 0, F.element_at(row, -1))


def contains_phrase(row: Column, phrase: tuple[str, ...]) -> Column:
    """Whether the tokens stand side by side in the row; the last may be a beginning of three characters or more."""
    wanted = " " + " ".join(map(_quoted, phrase)) + ("[^ ]* " if len(phrase[-1]) >= 3 else " ")
    return F.coalesce(F.concat(F.lit(" "), F.array_join(row, " "), F.lit(" ")).rlike(wanted), F.lit(False))


def is_subsequence(row: Column, wanted: tuple[str, ...]) -> Column:
    """Whether the tokens occur in this order, others between them allowed."""
    want = F.array(*[F.lit(w) for w in wanted])
    reached = F.aggregate(row, F.lit(0), lambda k, t: F.when((k < len(wanted)) & (F.get(want, k) == t), k + 1).otherwise(k))
    return reached == len(wanted)


def stable_id(*columns: Column, length: int = 16) -> Column:
    """The beginning of the SHA-256 of the columns joined by a unit separator; null as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.substring(F.sha2(joined, 256), 1, length)
