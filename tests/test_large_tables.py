"""What large tables and deep groups ask for, in small cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import cues
from tessera.operators import graph, intervals, syntax, windows
from tessera.plans import registry


@pytest.fixture
def few_rows(spark):
    """Recursive queries stop early here, as they do on large tables."""
    limits = {"spark.sql.cteRecursionRowLimit": "5", "spark.sql.cteRecursionLevelLimit": "3"}
    old = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_tree_depths_beyond_recursion_limits(spark, few_rows):
    chain = [(1, w, w - 1) for w in range(1, 201)]
    odd = [(2, 1, 0), (2, 2, 3), (2, 3, 2), (2, 4, None), (2, 5, 1), (2, 5, 1), (None, 1, 0), (None, 2, 1)]
    w = spark.createDataFrame(chain + odd, "sentence long, word int, head int").repartition(3)
    got = sorted(((r["sentence"] or 0, r["word"], r["depth"]) for r in graph.tree_depths(w).collect()))
    assert got == [(0, 1, 0)] + [(1, w, w - 1) for w in range(1, 201)] + [(2, 1, 0), (2, 5, 1)]


def test_groups_reach_across_batches(spark):
    w = spark.range(30).select((F.col("id") % 2).alias("sentence"), F.floor(F.col("id") / 2 + 1).cast("int").alias("word"), F.floor(F.col("id") / 2).cast("int").alias("head"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted((r["sentence"], r["word"], r["depth"]) for r in graph.tree_depths(w).collect()) == [(s, k + 1, k) for s in (0, 1) for k in range(15)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_span_heads_beyond_recursion_limits(spark, few_rows):
    w = spark.createDataFrame([(1, k, k - 1, 3 * k, 3 * k + 2) for k in range(1, 31)] + [(1, 7, 6, 21, 23)], "sentence long, word int, head int, start long, end long")
    s = spark.createDataFrame([(1, 1, 6, 12), (1, 2, 84, 200), (1, 3, 0, 2), (2, 1, 0, 9)], "sentence long, id int, start long, end long")
    got = sorted(tuple(r) for r in syntax.span_tree_features(w, s).collect())
    assert got == [(1, 1, 2, 2, 1, 1, 2, True, False), (1, 2, 3, 28, 27, 1, 1, True, True)]


def test_parse_violations_beyond_recursion_limits(spark, few_rows):
    good = [(1, k, k - 1) for k in range(1, 31)] + [(1, 1, 0)]
    bad = [(2, 1, 0), (2, 2, 0), (3, 1, 5), (4, 1, 0), (4, 2, 3), (4, 3, 2)]
    w = spark.createDataFrame(good + bad, "sentence long, word int, head int")
    assert sorted(tuple(r) for r in syntax.parse_violations(w).collect()) == [("head_missing", 3), ("roots", 2), ("roots", 3), ("unreached", 3), ("unreached", 4)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["j13_overlap_features", "j20_gold_labels", "a29_overlap_clusters", "x19_span_validity"])
def test_spans_are_not_joined(name, spark, sf):
    """Pairs of spans of a window never meet in a join, whose exchange is some twenty times the text."""
    assert "Join" not in plan_of(registry.queries()[name](spark, sf))


def test_interval_features_of_repeated_spans(spark):
    s = spark.createDataFrame([(1, 0, 4), (1, 0, 2), (1, 0, 2), (1, 1, 3), (2, 5, 6)], "window long, start int, end int")
    got = sorted(tuple(r) for r in intervals.interval_features(s, ["window"]).collect())
    assert got == [(1, 0, 2, 2, 4, 0, 2, 0, 2, 0), (1, 0, 4, 4, 3, 3, 0, 1, 2, 0), (1, 1, 3, 2, 3, 0, 1, 0, 0, 0), (2, 5, 6, 1, 0, 0, 0, 0, 0, 0)]


def test_run_sizes_without_runs(spark):
    """The same sums as over all runs, none of which is made."""
    w = spark.createDataFrame([(1, []), (2, ["a"]), (3, ["ab", "c", "def"]), (4, [str(k) for k in range(300)])], "id long, w array<string>")
    got = sorted(tuple(r) for r in windows.run_sizes(w, "w", 32).collect())
    runs = windows.ngrams(w, "w", 32).groupBy("id", "size").agg(F.count("phrase"), F.sum(F.length("phrase")))
    assert got == sorted(tuple(r) for r in runs.collect()) and len(got) == 1 + 3 + 32


def test_mention_candidates_make_no_runs(spark, sf):
    plan = plan_of(registry.queries()["t37_mention_candidates"](spark, sf))
    assert plan.count("Generate") == 1


def test_lexical_candidates_without_join(spark, monkeypatch):
    """The best windows are found without a row for each word that a window shares with a query; beyond the bound the join gives the same."""
    q = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, "zz"), (4, None)], "item_id long, text string")
    d = spark.createDataFrame([(k, " ".join(["a", "b", "x"][: k % 4] * 9 + [f"w{j}" for j in range(k * 7)])) for k in range(40)], "doc_id long, text string")
    fast = windows.lexical_candidates(q, d, 12, 6, 3)
    assert "Join" not in plan_of(fast)
    got = sorted(map(tuple, fast.collect()))
    monkeypatch.setattr(windows, "CELLS", -1)
    assert got == sorted(map(tuple, windows.lexical_candidates(q, d, 12, 6, 3).collect())) and len(got) == 6


def test_resolution_explodes_no_documents(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(300))
    q = spark.createDataFrame([(1, "w3 w4 w5"), (2, " ".join(f"w{k}" for k in range(90, 200))), (3, "w5 w4"), (4, "w7"), (5, "")], "item_id long, text string")
    d = spark.createDataFrame([(1, text), (2, "w3 w4 w5 w3 w4 w5"), (3, None)], "doc_id long, text string")
    found = windows.resolution(q, d)
    assert "posexplode" not in plan_of(found)
    got = sorted(map(tuple, found.collect()))
    assert [r[1] for r in got][:2] == ["ambiguous_exact", "exact"] and got[3][1:3] == ("exact", 1)
    monkeypatch.setattr(windows, "HELD_WORDS", -1)
    assert got == sorted(map(tuple, windows.resolution(q, d).collect()))


ODD = (
    "You know, I-mean it's KIND of, sort of thank-you knowing I, think -- ' \"q\" can’t CAN'T don’t 12 5% 5%% 3.5% ٣٤ ÉCOLE École école's x’s! 's 's_ _s a's9 ΑΣ ΑΣ's İstanbul ß SS ǅ Ⅷ ² x\x0bY x\fY "
    "kind of you,know sort-of iou mean Ed ING-ed bring s .. wave,ward 'tis if,only tower𝐀𝐁 𝐀 中文 中文-a é ’ % -ed no_ re's\u0085"
)


def test_flags_and_hints_by_word(spark):
    """Runs of words get the flags and hints that the functions on phrases give, odd words included; no phrase is made."""
    tokens = ODD.split(" ")
    w = spark.createDataFrame([(k, tokens[k : k + 7]) for k in range(len(tokens))] + [(1000, [])], "window long, w array<string>")
    s = windows.ngrams(w, "w", 3).select("window", (F.col("start") - 1).cast("long").alias("start"), (F.col("start") - 1 + F.col("size")).cast("long").alias("stop"), "phrase")
    s = s.withColumn("r", cues.words(F.col("phrase"))).withColumn("l", F.transform("r", F.lower))
    want = s.select("window", "start", "stop", *[c.alias(n) for n, c in cues.surface_flags(F.col("phrase"), F.col("r"), F.col("l")).items()])
    got = windows.run_flags(w, "w", 3)
    assert got.columns == want.columns
    rows = lambda df: {tuple(r)[:3]: r.asDict() for r in df.collect()}
    a, b, phrase = rows(got), rows(want), {tuple(r)[:3]: r["phrase"] for r in s.collect()}
    assert set(a) == set(b) and len(a) == got.count()
    assert [(phrase[k], c) for k in a for c in got.columns if a[k][c] != b[k][c]] == []
    plain = F.transform("l", lambda x: F.replace(x, F.lit("’"), F.lit("'")))
    want = rows(s.select("window", "start", "stop", F.array_join(cues.type_hints(F.col("phrase"), plain), ",").alias("hints")))
    got = rows(windows.run_hints(w, "w", 3))
    assert set(got) == set(want) and [(phrase[k], got[k]["hints"], want[k]["hints"]) for k in got if got[k] != want[k]] == []


@pytest.mark.parametrize("name", ["v13_surface_features", "t36_type_hints"])
def test_no_phrases_are_made(name, spark, sf):
    assert plan_of(registry.queries()[name](spark, sf)).count("Generate") == 1
