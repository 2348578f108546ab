"""The deterministic envelope of operators that ask a language model.

The model is a callable from a prompt to a text, given by the caller; it runs once for each row on the executors and must
be picklable. What it returns is parsed, checked and numbered here; invalid answers leave a row without result and are
counted, they never fail a batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import spans as S
from tessera.functions import text as T

Chat = Callable[[str], str]


def ask(df: DataFrame, prompt: Column, chat: Chat, *, name: str = "answer") -> DataFrame:
    """Adds the answer to each row's prompt; an error of the callable is a null answer."""

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(p):
            try:
                return chat(p)
            except Exception:  # noqa: BLE001
                return None

        for s in prompts:
            yield s.map(one)

    return df.withColumn(name, run(prompt))


def extract_facts(documents: DataFrame, chat: Chat, *, size: int = 10_000) -> DataFrame:
    """doc_id, chunk, item, text, id: facts that the model finds in each chunk, each document's equal ones once."""
    chunks = documents.select("doc_id", F.posexplode(S.chunked(F.col("text"), size)).alias("chunk", "c")).select("doc_id", "chunk", F.col("c.text").alias("part"))
    answered = ask(chunks, F.concat(F.lit("List the facts of this text as JSON.\n"), "part"), chat)

    @F.pandas_udf("array<string>")
    def items(raw: pd.Series) -> pd.Series:
        return raw.map(S.lenient_items)

    facts = answered.select("doc_id", "chunk", F.posexplode(items("answer")).alias("item", "text"))
    first = facts.groupBy("doc_id", "text").agg(F.min(F.struct("chunk", "item")).alias("m")).select("doc_id", "m.chunk", "m.item", "text")
    return first.withColumn("id", T.stable_id(F.col("doc_id"), F.col("text")))


def label_facts(facts: DataFrame, done: DataFrame, chat: Chat, allowed: tuple[str, ...]) -> DataFrame:
    """id and tags of facts without a label yet; tags that aren't allowed are dropped, invalid answers give no row."""
    todo = facts.join(done.select("id"), "id", "left_anti")
    answered = ask(todo, F.concat(F.lit("Tags as a JSON object with the key tags:\n"), "text"), chat)

    @F.pandas_udf("array<string>")
    def tags(raw: pd.Series) -> pd.Series:
        def one(r):
            found = S.strict_object(r, frozenset(("tags",)))
            values = json.loads(found)["tags"] if found else None
            return list(dict.fromkeys(t.lower() for t in values if isinstance(t, str) and t.lower() in allowed)) if isinstance(values, list) else None

        return raw.map(one)

    return answered.select("id", tags("answer").alias("tags")).where("tags IS NOT NULL")


def select_candidates(windows: DataFrame, chat: Chat) -> DataFrame:
    """window, candidate, decision: a closed choice among the candidates (ids) of each window.

    The answer must be a JSON object with the key selected, a list of ids of this window, none twice; else the window's
    decision is invalid and selects nothing.
    """
    asked = ask(windows, F.concat(F.lit("Choose from "), F.to_json("candidates")), chat)

    @F.pandas_udf("struct<ok:boolean,ids:array<string>>")
    def parsed(raw: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        rows = []
        for r, c in zip(raw, candidates, strict=True):
            found = S.strict_object(r, frozenset(("selected",)))
            ids = json.loads(found)["selected"] if found else None
            ok = isinstance(ids, list) and len(set(map(str, ids))) == len(ids) and set(ids) <= set(c)
            rows.append((ok, list(ids) if ok else []))
        return pd.DataFrame(rows, columns=["ok", "ids"])

    out = asked.withColumn("p", parsed("answer", "candidates"))
    return out.select("window", F.explode("candidates").alias("candidate"), "p").select("window", "candidate", F.when(~F.col("p.ok"), "invalid").when(F.array_contains("p.ids", F.col("candidate")), "selected").otherwise("rejected").alias("decision"))


def slot_candidates(texts: DataFrame, aliases: DataFrame, most: int) -> DataFrame:
    """id, slot, name, score: entities, relations and concepts whose alias stands in a text, by the share of its words found.

    ``aliases``: slot, name, alias. Texts and aliases meet by word; an alias that is there in full scores 1.
    """
    t = texts.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    a = aliases.select("slot", "name", "alias", F.array_distinct(T.tokens(F.col("alias"))).alias("w")).withColumn("n", F.size("w"))
    hits = t.join(a.select("slot", "name", "alias", "n", F.explode("w").alias("token")), "token")
    score = hits.groupBy("id", "slot", "name", "alias", "n").agg((F.count(F.lit(1)) / F.col("n")).alias("score"))
    best = score.groupBy("id", "slot", "name").agg(F.max("score").alias("score"))
    ranked = best.groupBy("id", "slot").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name"))), 1, most).alias("top"))
    return ranked.select("id", "slot", F.explode("top").alias("x")).select("id", "slot", F.col("x.name").alias("name"), F.round(-F.col("x.s"), 6).alias("score"))


def normalised_question(text: str) -> str:
    """A question without filler and doubled spaces, closed by one mark: what is asked when no model is at hand."""
    bare = re.sub(r"\b(?:please|um+|uh+|like|hey)\b,?", " ", text, flags=re.I)
    return re.sub(r"\s+", " ", bare).strip(" ?!.") + "?"


def mechanical(text: str | None) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A text with white space collapsed and sentences capitalised, and how its parts map: (from, to, start, end) spans."""
    out, maps, at = [], [], 0
    fresh = True
    for m in re.finditer(r"\S+", text or ""):
        word = m[0]
        shown = word[:1].upper() + word[1:] if fresh else word
        if out:
            at += 1
        out.append(shown)
        maps.append((m.start(), m.end(), at, at + len(shown)))
        at += len(shown)
        fresh = word[-1:] in ".!?"
    return " ".join(out), maps


def letters_preserved(old: str, new: str) -> bool:
    """Whether two texts have the same letters and digits in order, case aside."""
    keep = lambda s: [c.lower() for c in s if c.isalnum()]
    return keep(old) == keep(new)
