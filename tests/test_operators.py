"""Small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import spans as S
from tessera.functions import text as T
from tessera.operators import graph, intervals, metrics, ranking, retrieval, upserts, vectors, windows
from tessera.sources import captions, pages


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_tokens_and_keys(spark):
    assert one(spark, T.tokens(F.lit("A,,b-É 12x"))) == ["a", "b", "12x"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, T.name_key(F.lit("Cho'Gath  II."))) == "chogath  ii"
    assert one(spark, T.spoken_key(F.lit("Kai'Sa's  Q_w"))) == "kaisa q w"
    assert one(spark, T.non_empty(F.lit("  "), F.lit(" b "))) == "b"


def test_phrases(spark):
    row = F.array(*[F.lit(w) for w in "push the wave slowly then roam".split()])
    assert one(spark, T.contains_phrase(row, ("the", "wav")))
    assert not one(spark, T.contains_phrase(row, ("the", "wa"))) and one(spark, T.contains_phrase(row, ("roam",)))
    assert not one(spark, T.contains_phrase(row, ("roam", "push"))) and not one(spark, T.contains_phrase(F.lit(None).cast("array<string>"), ("a",)))
    assert one(spark, T.is_subsequence(row, ("push", "then", "roam"))) and not one(spark, T.is_subsequence(row, ("then", "push")))
    assert one(spark, T.head_token(row, ("roam", "then"))) == "slowly"


def test_windows(spark):
    def df(n):
        return spark.createDataFrame([(1, " ".join(map(str, range(n))))], "id long, text string")

    assert [r["start"] for r in windows.word_windows(df(45), 40, 20).collect()] == [0]
    assert sorted(r["start"] for r in windows.word_windows(df(60), 40, 20).collect()) == [0, 20]
    assert sorted(r["start"] for r in windows.context_windows(df(200), 120, 24).collect()) == [0, 96]


def test_coalesced_spans(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (1, 11, 11)], "id long, start long, end long")
    assert sorted((r["start"], r["end"]) for r in windows.coalesced(s, ["id"]).collect()) == [(0, 8), (10, 12)]


def test_rrf(spark):
    a = spark.createDataFrame([("a", 1, None), ("b", 2, 1), ("c", None, 2)], "id string, v int, w int")
    got = {r["id"]: r["f"] for r in a.select("id", retrieval.rrf(F.col("v"), F.col("w")).alias("f")).collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["a"] == pytest.approx(1 / 61) and got["c"] == pytest.approx(1 / 62)


def test_bm25_repeats_count_twice(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "y z")], "id long, text string")
    once = {r["id"]: r["bm25"] for r in retrieval.bm25(df, "x").collect()}
    twice = {r["id"]: r["bm25"] for r in retrieval.bm25(df, "x x").collect()}
    assert twice[1] == pytest.approx(2 * once[1]) and once[2] == 0
    alone = retrieval.bm25(df.where("id = 1"), "x").first()["bm25"]
    assert alone == pytest.approx(math.log(0.5 / 1.5 + 1) * 2.5 / 2.5)


def test_cluster_scores(spark):
    rows = [(1, 1, "g", [1.0, 0.0], 0.5), (2, 2, "g", [1.0, 0.0], None), (3, 3, "h", [1.0, 0.0], 0.5), (4, 1, "g", [1.0, 0.0], 0.5)]
    df = spark.createDataFrame(rows, "id long, owner long, game string, vector array<double>, source_score double")
    got = {r["id"]: (r["neighbours"], r["cluster_score"], r["confidence"]) for r in vectors.cluster_scores(df, F.col("game"), 0.7).collect()}
    assert got[3] == (0, 0.0, 0.3)
    assert got[1] == (1, 0.3333, 0.4333) and got[2] == (2, 0.6667, 0.5667)


def test_greedy_duplicates(spark):
    a, b, c = [1.0, 0.0], [0.9, math.sqrt(1 - 0.81)], [0.62, math.sqrt(1 - 0.62**2)]
    df = spark.createDataFrame([(1, 7, 0.8, a), (2, 7, 0.4, b), (3, 7, 0.9, c)], "id long, video long, source_score double, vector array<double>")
    got = {r["id"]: (r["repetition_count"], r["is_duplicate"]) for r in vectors.greedy_duplicates(df, "video", 0.88).collect()}
    assert got == {1: (2, False), 2: (1, True), 3: (1, False)}


def test_centroids_and_neighbours(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0])], "k string, v array<double>")
    got = {r["k"]: (r["vector"], r["n"]) for r in vectors.centroids(df, ["k"], "v").collect()}
    assert got["a"][0] == pytest.approx([math.sqrt(0.5)] * 2) and got["a"][1] == 2 and got["z"][0] is None
    q = spark.createDataFrame([(i, i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(30)], "id long, owner long, vector array<double>")
    near = {(r["id"], r["place"]): r["other"] for r in vectors.nearest(q, q, 2, tile=7).collect()}
    assert near[(0, 1)] == 1 and near[(0, 2)] == 2 and {near[(5, 1)], near[(5, 2)]} == {4, 6}


def test_weights_and_bonuses(spark):
    guide = F.lit(ranking.GUIDES)
    assert one(spark, ranking.source_weight(guide, F.lit("Challenger"), F.lit(9.5))) == pytest.approx(2.10)
    assert one(spark, ranking.source_weight(guide, F.lit("emerald"), F.lit(99.0))) == pytest.approx(0.7 * 1.15)
    assert one(spark, ranking.source_weight(guide, F.lit(None).cast("string"), F.lit(None).cast("double"))) == 1.0
    assert one(spark, ranking.source_weight(F.lit("aoe2_pdf"), F.lit("challenger"), F.lit(9.5))) == 2.0
    assert one(spark, ranking.source_weight(F.lit(None).cast("string"), F.lit(""), F.lit(1.0))) == pytest.approx(1.6)
    types = [f"t{i}" for i in range(8)]
    got = [one(spark, ranking.preferred_bonus(F.lit(t), types)) for t in types]
    assert got == pytest.approx([0.12, 0.10, 0.08, 0.06, 0.04, 0.02, 0, 0])


def test_peer_z(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("c", 5.0), ("c", 5.0), ("c", 5.0)], "g string, v double")
    got = sorted((r["g"], r["z"]) for r in ranking.peer_z(df, ["g"], "v").collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 0.0), ("b", 1.0), ("c", 0.0), ("c", 0.0), ("c", 0.0)]


def test_nearest_in_time(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 02:00:00"), (3, 2, "2024-01-01 00:00:00"), (4, 2, "2024-01-01 02:00:01")]
    e = spark.createDataFrame(rows, "event_id long, user_id long, t string").withColumn("ts", F.to_timestamp_ntz("t"))
    a, b = e.where("event_id IN (1, 3)"), e.where("event_id IN (2, 4)")
    for f in (ranking.nearest_in_time, ranking.nearest_consumed):
        assert [(r["event_id"], r["nearest"], r["gap"]) for r in f(a, b, "user_id", 7200).collect()] == [(1, 2, 7200)]


def test_evenly(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    want = {round(k * 99 / 19) for k in range(20)}
    assert {r["x"] for r in ranking.evenly(df, "x", 20).collect()} == want
    assert ranking.evenly(spark.range(5).withColumnRenamed("id", "x"), "x", 20).count() == 5


def test_interval_predicates(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 0, 4), (1, 2, 4), (1, 10, 12)], "window long, start long, end long")
    got = {(r["start"], r["end"]): r for r in intervals.interval_features(s, ["window"]).collect()}
    assert (got[(0, 10)]["overlapping"], got[(0, 10)]["contained"], got[(0, 10)]["strictly_contained"]) == (2, 2, 1)
    assert got[(2, 4)]["containers"] == 2 and got[(10, 12)]["overlapping"] == 0 and got[(0, 4)]["same_start"] == 1


def test_metrics(spark):
    rows = [(1, "w", 0.9, True), (2, "w", 0.8, False), (3, "w", 0.8, True), (4, "w", 0.1, False), (5, "v", 0.4, True)]
    df = metrics.ranked(spark.createDataFrame(rows, "id long, window string, score double, positive boolean"), ["window"])
    q = {r["window"]: r for r in metrics.ranking_quality(df, ["window"]).collect()}
    assert q["w"]["average_precision"] == pytest.approx((1 + 2 / 3) / 2) and q["w"]["roc_auc"] == pytest.approx(3.5 / 4) and q["v"]["roc_auc"] is None
    c = {r["window"]: r for r in metrics.confusion(df, ["window"]).collect()}
    assert (c["w"]["tp"], c["w"]["fp"], c["w"]["tn"]) == (2, 1, 1) and c["v"]["precision"] is None and c["v"]["recall"] == 0
    w = spark.range(10).select((F.col("id") < 2).alias("positive"), F.lit("x").alias("g"))
    r = metrics.class_weights(w, ["g"]).first()
    assert (r["positive_weight"], r["negative_weight"]) == (2.5, 0.625)


def test_graph(spark):
    rows = [("A", "supports", "B", "c", 0.5, 1, 1), ("a ", "supports", "b", "C", 0.7, 2, 1), ("A", "counters", "B", "c", 0.9, 3, 2), ("B", "needs", "D", "c", 0.9, 4, 2)]
    r = spark.createDataFrame(rows, "subject string, relation_type string, object string, condition string, confidence double, evidence_id long, source_id long")
    m = {x["relation_type"]: x for x in graph.merged(r).collect()}
    assert m["supports"]["confidence"] == 0.7 and m["supports"]["evidence"] == [1, 2] and m["supports"]["sources"] == 1
    found = {(x["node"], x["hop"]) for x in graph.bounded_search(graph.merged(r.where("confidence >= 0.9")), ["A"], 2, 10).collect()}
    assert found == {("A", 0), ("B", 1), ("D", 2)}
    assert one(spark, graph.weighed(F.lit(0.3), F.lit(0.3), F.lit(1.0))) == pytest.approx(0.37)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(upserts.upsert(old, new, ["id"])) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(upserts.insert_or_ignore(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(upserts.update_from(old, new, ["id"], ["v"]).select("id", "v")) == [(1, "a"), (2, "B")]


def test_publish(spark, tmp_path):
    path = upserts.publish(spark.range(50), f"file://{tmp_path}/t")
    assert upserts.verified(spark, path)
    spark.range(51).write.mode("overwrite").parquet(path)
    assert not upserts.verified(spark, path)


def test_segments():
    text = "One two. Three four five! " + "word " * 40 + "but " + "x " * 10 + "end"
    found = S.segments(text)
    assert [k for *_, k in found][:2] == ["sentence", "sentence"]
    assert all(text[a:b] == t and t.strip() == t and len(t.split()) <= 32 for a, b, t, _ in found)
    assert " ".join(t for *_, t, _ in [(a, b, t, k) for a, b, t, k in found]).split() == text.split()
    for text in ("Pi is 3.14 today. Next one.", 'He said "Go." Then she left.', "See example.com for more. ", "a.b.c!? d", " no end so it goes ", "...", "He said “go!”)] Next move."):
        found = S.segments(text)
        assert "".join("".join(t.split()) for *_, t, _ in found) == "".join(text.split())
        assert all(text[a:b] == t for a, b, t, _ in found)
    assert [t for *_, t, _ in S.segments("Pi is 3.14 today. Next one.")] == ["Pi is 3.14 today.", "Next one."]
    assert [t for *_, t, _ in S.segments('He said "Go." Then she left.')] == ['He said "Go."', "Then she left."]
    assert [t for *_, t, _ in S.segments("He said “go!”)] Next move.")] == ["He said “go!”)]", "Next move."]
    got = S.segments("When it misses, you can walk forward because she can't stop you. Once it is back, respect her.")
    assert [(t, k) for *_, t, k in got] == [("When it misses, you can walk forward", "discourse"), ("because she can't stop you.", "discourse"), ("Once it is back, respect her.", "sentence")]
    assert [k for *_, k in S.segments(" ".join(f"w{i}" for i in range(70)))] == ["fallback"] * 3
    chunks = S.char_chunks("Aa bb. " * 900, 1000, 200)
    assert all(len(t) <= 1000 and t.endswith(".") for *_, t in chunks) and " ".join(t for *_, t in chunks).split() == ("Aa bb. " * 900).split()
    assert S.char_chunks(None) == [] and S.segments("") == []


def test_spans():
    assert [s[:2] for s in S.bounded_spans("Vi's vi, via VI", "vi", True)] == [(0, 4), (5, 7), (13, 15)]
    assert S.literal_spans("a  B\nc", "b c") == [(3, 6, "B\nc")]
    assert S.fuzzy_names("Bryton and Saracens", ("Britons", "Saracens")) == [(0, 6, "Britons"), (11, 19, "Saracens")] or S.fuzzy_names("the Saracens", ("Saracens",)) == [(4, 12, "Saracens")]


def test_negation_near_a_predicate():
    assert S.negated_near("You should never fight here", "fight") and S.negated_near("they fight nobody", "fight")
    assert not S.negated_near("no one may fight", "fight") and not S.negated_near("fight, not flight", "fight")
    assert not S.negated_near("not a b c d fight", "fight") and S.negated_near("not a b c fight", "fight")
    assert not S.negated_near("never fighting", "fight") and not S.negated_near("fight for us none", "fight")
    assert S.negated_near("Fight. Cannot FIGHT", "fight") and not S.negated_near(None, "fight")


def test_token_windows(spark):
    df = spark.createDataFrame([(1, " ".join(f"W{i}," for i in range(45))), (2, None), (3, " .. ")], "id long, text string")
    got = {(r["id"], r["k"]): r["w"] for r in windows.token_windows(df, 20).collect()}
    assert got == {(1, k): [f"w{i}" for i in range(20 * k, min(20 * k + 20, 45))] for k in range(3)}


def test_last_words_lie_in_a_window(spark):
    """A quotation of the last words is found, in the window that starts at the last stride."""
    text = " ".join(f"w{i}" for i in range(179))
    d = spark.createDataFrame([(7, text), (8, "w1 other")], "doc_id long, text string")
    q = spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(150, 179)))], "item_id string, text string")
    best = windows.lexical_candidates(q, d, 120, 60, 2).orderBy(F.desc("score")).collect()
    assert [(r["doc_id"], r["start"]) for r in best] == [(7, 120), (7, 60)] and best[0]["score"] == pytest.approx(0.8 + 0.2 * 29 / 59, abs=1e-6)


def test_numbered(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 101) for i in range(101)], "g long, x long")
    got = ranking.numbered(df, ["g"], "x", "place", 7).collect()
    want = sorted((r["g"], r["x"]) for r in got)
    assert [(r["g"], r["x"]) for r in sorted(got, key=lambda r: r["place"])] == want and {r["place"] for r in got} == set(range(1, 102))
    assert ranking.numbered(df.where("false"), ["g"], "x", "place").count() == 0


def test_json():
    assert S.strict_object('```json\n{"a": 1}\n```', frozenset("a")) == '{"a": 1}'
    assert S.strict_object('{"a": 1, "a": 2}', frozenset("a")) is None and S.strict_object('{"b": 1}', frozenset("a")) is None
    assert S.lenient_items('Sure: {"x": ["one", {"text": "two"}, 3]} done') == ["one", "two"] and S.lenient_items("none") == []


def test_captions_and_pages(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:00.000 --> 00:01.000\n<c>Hello</c> there\nHello there\n\n00:01.000 --> 00:02.000\nBye"
    df = spark.createDataFrame([(1, vtt)], "id long, vtt string")
    assert captions.caption_text(df, "id", "vtt").first()["text"] == "Hello there Bye"
    html = "<title>T</title><h2>Head</h2><p>See <a href='/x'>this</a> now</p><ul><li>one</li><li>one</li></ul><script>no</script>"
    p = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert {r["page_id"]: r["body"] for r in pages.sections(p).collect()} == {1: "## Head\nSee this now\n- one", 2: ""}
    assert [(r["href"], r["around"]) for r in pages.links(p).collect()] == [("/x", "See this now")]
    a = spark.createDataFrame([("Yes.\nSources:\n[1] Guide | top | 0.9\nnoise\n[2] Wiki",)], "t string")
    r = pages.split_answer(a, "t").first()
    assert r["answer"] == "Yes." and [(s["label"], s["scope"], s["score"]) for s in r["sources"]] == [("Guide", "top", 0.9), ("Wiki", None, None)]


def test_extraction_survives_bad_answers(spark):
    from tessera.operators import extraction

    df = spark.createDataFrame([(1, "One. Two."), (2, "Bad."), (3, None)], "doc_id long, text string")

    def chat(prompt):
        if "Bad" in prompt:
            raise RuntimeError("no answer")
        return 'Here: ["One", {"text": "Two"}, "One", 4]'

    got = extraction.extract_facts(df, chat).select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "One"), (1, "Two")]
    assert extraction.normalised_question("Hey, um please how  do I win ??") == "how do I win?"
    shown, maps = extraction.mechanical("hello  there. bye")
    assert shown == "Hello there. Bye" and maps == [(0, 5, 0, 5), (7, 13, 6, 12), (14, 17, 13, 16)]
    assert extraction.letters_preserved("hello  there. bye", shown) and not extraction.letters_preserved("a b", "a c")


def test_files(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "a.csv").write_text('name,URL\n"x, y",\n ,http://u\n')
    (tmp_path / "b.json").write_text('[{"name": "z", "link": "l"}]')
    a, b = (files.read_rows(spark, f"file://{tmp_path}/{n}") for n in ("a.csv", "b.json"))
    assert [r["x"] for r in a.select(files.pick(a, "link", "URL", "name", default="-").alias("x")).collect()] == ["x, y", "http://u"]
    assert b.select(files.pick(b, "URL", "link").alias("x")).first()["x"] == "l"
    with pytest.raises(ValueError):
        files.read_rows(spark, "x.xml")
    assert files.with_defaults(None, {"id": ("bigint", 0)}, spark).count() == 0


def test_incremental(spark, tmp_path):
    from tessera.streaming import incremental

    at = {k: f"file://{tmp_path}/{k}" for k in ("in", "out", "check")}
    spark.range(5).write.parquet(at["in"])
    step = lambda df: df.where("id % 2 = 0")
    args = (spark, at["in"], "id long", at["out"], at["check"], step)
    assert incremental.process_new(*args) == 3 and incremental.process_new(*args) == 0
    spark.range(10, 14).write.mode("append").parquet(at["in"])
    assert incremental.process_new(*args) == 2 and spark.read.parquet(at["out"]).count() == 5


def test_proposition_stages():
    """Closed answers: what is refused, at which stage, and what is placed."""
    import json

    from tessera.operators import propositions as P

    text = "Ward early. Warding early wins fights because vision wins fights. Rest."
    clauses = {"c1": ("insight", 0, 11), "c2": ("insight", 12, 65), "c3": ("insight", 66, 71), "t1": ("transcript", 0, 4)}
    sources = {"insight": text, "transcript": "Ward"}
    good = {
        "evidence": {"source": "insight", "candidate_ids": ["c2"]}, "actor": {"actor": "Warding early"}, "event": {"event": "because"}, "effect": {"effect": "vision"},
        "condition": {"condition": "NONE"}, "direction": {"causal_direction": "actor_event_causes_effect"}, "normalization": {"actor_concept": "vision", "event_relation": "needs", "effect_concept": None},
    }

    def run(**changed):
        answers = good | changed
        chat = lambda stage, shown: answers[stage] if isinstance(answers[stage], str) else json.dumps(answers[stage])
        return P.proposition(chat, sources, clauses, frozenset(("vision",)), frozenset(("needs",)))

    got = run()
    assert got["stage"] == "assembled" and (got["actor"], got["actor_start"], got["effect_start"]) == ("Warding early", 12, 46) and "condition" not in got and got["effect_concept"] is None
    pick = lambda *ids, source="insight": {"evidence": {"source": source, "candidate_ids": list(ids)}}
    refused = [
        (pick("c2", "c2"), "evidence", "twice"), (pick("c9"), "evidence", "unknown"), (pick("t1"), "evidence", "mixed"), (pick("c1", "c2", "c3"), "evidence", "count"), (pick("c1", source="web"), "evidence", "source"),
        ({"evidence": '{"source": "insight", "candidate_ids": ["c2"], "more": 1}'}, "evidence", "shape"), ({"evidence": "no json"}, "evidence", "shape"),
        ({"actor": {"actor": "wins fights"}}, "actor", "ambiguous"), ({"actor": {"actor": "Ward early"}}, "actor", "outside"), ({"event": {"event": " "}}, "event", "phrase"), ({"effect": {"effect": "visio"}}, "effect", "outside"),
        ({"condition": {"effect": "vision"}}, "condition", "shape"), ({"direction": {"causal_direction": "both"}}, "direction", "label"), ({"direction": {"causal_direction": "association_only"}}, "abstained", "association_only"),
        ({"normalization": good["normalization"] | {"effect_concept": "magic"}}, "normalization", "invented"), ({"normalization": good["normalization"] | {"event_relation": 3}}, "normalization", "type"),
        ({"evidence": {"source": None, "candidate_ids": []}}, "abstained", "none"),
    ]
    for change, stage, code in refused:
        assert (run(**change)["stage"], run(**change)["code"]) == (stage, code), change
    assert run(**pick("c1", "c2"), actor={"actor": "Ward early"})["actor_start"] == 0
    assert P.coalesced([(12, 65), (0, 11), (66, 71)], text) == [(0, 71)] and P.coalesced([(0, 4), (12, 20)], text) == [(0, 4), (12, 20)]
