from pyspark.sql import functions as F

from quarryframe.functions import ids, labels
from quarryframe.operators import coverage, discover, evaluation, graph, history, linking, retrieval
from quarryframe.plans import planner
from quarryframe.plans.engine import Knowledge, answer
from quarryframe.sources import files as sources

ENT = "entity_id string, repo_id string, kind string, label string, path string, generation_id string, evidence_id string, identity string"
CLM = "claim_id string, subject_id string, predicate string, object_id string, confidence double"


def entities(spark, rows):
    return spark.createDataFrame([r + (None,) * (8 - len(r)) for r in rows], ENT)


def test_links_need_two_repositories_and_equal_identities(spark):
    e = entities(spark, [("a", "one", "k", " OrderChanged "), ("b", "two", "k", "OrderChanged"), ("c", "two", "k", "orderchanged"), ("d", "one", "k", "OrderChanged"), ("n", "two", "k", None)])
    c = spark.createDataFrame([("1", "s", "PUBLISHES_EVENT", "a", 0.9), ("2", "s", "CONSUMES_EVENT", "b", 0.5), ("3", "s", "CONSUMES_EVENT", "c", 0.5), ("4", "s", "CONSUMES_EVENT", "d", 0.5), ("5", "s", "CONSUMES_EVENT", "n", 0.5), ("6", None, None, None, None)], CLM)
    rows = linking.links(linking.memberships(c, e)).collect()
    assert [(r.subject_id, r.object_id, r.predicate, r.confidence) for r in rows] == [("a", "b", "EVENT_PRODUCER_CONSUMER", 0.5)]


def test_normalized_identities(spark):
    rows = [("INVOKES_API", "get  /x/"), ("INVOKES_API", "/x"), ("INVOKES_API", "GET x"), ("INVOKES_API", "GET /"), ("DEFINES_CONFIGURATION", "My_App--Url."), ("PRODUCES_TOPIC", " T "), ("CALLS", "x"), ("PUBLISHES_EVENT", " ")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, l string").select(labels.normalized_identity(F.col("p"), F.col("l"))).collect()]
    assert got == ["GET /x", None, None, "GET /", "my.app.url", "t", None, None]


def test_reach_and_paths(spark):
    c = spark.createDataFrame([(str(k), a, "CALLS", b, 1.0) for k, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", None), ("a", "b")])], CLM)
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.reach(seeds, graph.edges(c, "out"), 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    goals = spark.createDataFrame([("d",), ("z",)], "node string")
    assert [tuple(r) for r in graph.shortest_paths(seeds, goals, graph.edges(c), 3).collect()] == [("a", "d", 2)]


def test_states(spark):
    df = spark.createDataFrame([(1, True), (0, True), (0, False)], "n int, c boolean").select(coverage.state(F.col("n"), F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == ["found", "not_found", "unknown"]


def test_globs_and_reasons(spark):
    paths = ["src/a/b/X.java", "src/X.java", "lib/node_modules/x.js", "build/x.js", "a/.env", "docs/a.md", "my-secrets/x", "ok.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", discover.matches_glob(F.col("path"), "src/**/*.java").alias("g"), discover.reason(F.col("path"), exclude=("docs/*",)).alias("r"))
    rows = {r.path: (r.g, r.r) for r in df.collect()}
    assert [p for p in paths if rows[p][0]] == paths[:2]
    assert [rows[p][1] for p in paths] == ["", "", "vendor", "generated", "built_in_policy", "catalog_pattern", "built_in_policy", ""]


def test_quality_and_percentiles(spark):
    r = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("c", 1, False)], "case string, rank int, relevant boolean")
    q = evaluation.quality(r).first()
    assert (q.cases, round(q.mrr, 3), round(q.precision_at_1, 3)) == (3, 0.5, 0.333)
    v = spark.createDataFrame([("k", float(x)) for x in range(1, 11)] + [("k", None)], "g string, v double")
    assert evaluation.nearest_rank(v, "g", "v", 0.95).first().percentile == 10.0
    assert evaluation.nearest_rank(v, "g", "v", 0.5).first().percentile == 5.0


def test_modules_and_lines(spark):
    f = spark.createDataFrame([("r", "a/package.json"), ("r", "a/b/x.ts"), ("r", "c/x.ts"), ("r", "x.ts")], "repo_id string, path string")
    assert {r.path: r.module for r in history.module_of(f, r"(^|/)package\.json$").collect()} == {"a/package.json": "a", "a/b/x.ts": "a", "c/x.ts": "c", "x.ts": "."}


def test_handles_round_trip(spark):
    h = spark.createDataFrame([("g", "é/+?")], "g string, i string").select(ids.handle("e", "g", "i").alias("h")).first().h
    assert ids.read_handle(h, "e") == ("g", "é/+?")


def test_bm25_counts_neighbouring_phrases(spark):
    d = spark.createDataFrame([(1, "a b a b"), (2, "ab"), (3, None), (4, "A  B!")], "id int, text string")
    assert {r.id: r.hits for r in retrieval.bm25(d, "id", "text", "a b").collect()} == {1: 2, 4: 1}


def test_answers(spark):
    e = entities(spark, [("e1", "one", "symbol:class", "UserDirectory", "a/U.java", "g", "v1", ""), ("e2", "one", "symbol:method", "find", "a/U.java", "g", "v2", "")])
    c = spark.createDataFrame([("1", "e1", "CALLS", "e2", 0.7)], CLM)
    f = spark.createDataFrame([("one", "g", "a/U.java", "class U {}")], "repo_id string, generation_id string, path string, content string")
    d = spark.createDataFrame([], "generation_id string, code string")
    k = Knowledge(e, c, f, d)
    got = answer(k, planner.Request(text="userdirectory"))
    assert got.state == "found" and [r.entity_id for r in got.rows.collect()] == ["e1"]
    assert answer(k, planner.Request(text="absent_thing")).state == "not_found"
    broken = Knowledge(e, c, f.withColumn("content", F.lit(None).cast("string")), d)
    assert answer(broken, planner.Request(text="absent_thing")).state == "unknown"
    assert answer(k, planner.Request(text="UserDirectory", intent="references")).rows.count() == 2


def test_sources_and_revisions(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "A.java").write_text("class A {}")
    (root / "b.bin").write_bytes(b"\xff\x00")
    df = sources.read_tree(spark, str(root), "r")
    assert {r.path: (r.language, r.content) for r in df.collect()} == {"src/A.java": ("java", "class A {}"), "b.bin": ("text", None)}
    sources.stage({"files": df}, str(tmp_path / "ir"), "1", "r")
    sources.activate(spark, str(tmp_path / "ir"), "1")
    sources.stage({"files": df.limit(1)}, str(tmp_path / "ir"), "2", "r")
    assert sources.read_active(spark, str(tmp_path / "ir"), "files").count() == 2
    sources.activate(spark, str(tmp_path / "ir"), "2")
    assert sources.read_active(spark, str(tmp_path / "ir"), "files").count() == 1
    import pytest

    with pytest.raises(ValueError):
        sources.stage({"files": df}, str(tmp_path / "ir"), "3", "other")
