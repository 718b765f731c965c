import pytest

from quirewright.functions import text
from quirewright.operators import events, quality
from quirewright.streaming import events as stream


def test_gates_and_regressions(spark):
    now = spark.createDataFrame([("text.exact_match_rate", 0.8, 5), ("text.mean_word_error_rate", 0.2, 5)], "metric STRING, value DOUBLE, sample_count LONG")
    old = spark.createDataFrame([("text.exact_match_rate", 1.0, 5), ("text.mean_word_error_rate", 0.1, 5)], "metric STRING, value DOUBLE, sample_count LONG")
    rules = spark.createDataFrame([("text.exact_match_rate", 0.1, 1), ("text.mean_word_error_rate", 0.1, 1), ("none", 0.1, 1)], "metric STRING, maximum_degradation DOUBLE, minimum_samples INT")
    got = {r.metric: (r.degradation, r.status) for r in quality.regressions(rules, now, old).collect()}
    assert got["text.exact_match_rate"] == (0.2, "failed") and got["text.mean_word_error_rate"] == (0.1, "passed")
    assert got["none"] == (None, "not_evaluated")
    asked = spark.createDataFrame([("text.exact_match_rate", "minimum", 0.8, 1), ("text.mean_word_error_rate", "maximum", 0.1, 1), ("text.exact_match_rate", "minimum", 0.1, 9)], "metric STRING, comparator STRING, threshold DOUBLE, minimum_samples INT")
    gates = quality.gates(asked, now)
    assert sorted(r.status for r in gates.collect()) == ["failed", "not_evaluated", "passed"]
    assert quality.report_status(gates).first().status == "failed"
    assert quality.report_status(gates.filter("status = 'x'")).first().status == "observational"


def test_observations_of_nothing_are_absent(spark):
    none = spark.createDataFrame([], "exact_match BOOLEAN, character_error_rate DOUBLE, word_error_rate DOUBLE")
    assert quality.text_observations(none).count() == 0


def test_citation_scores_and_findings(spark):
    made = spark.createDataFrame([("q1", ["a", "a", "b"]), ("q2", [])], "query_id STRING, chunk_ids ARRAY<STRING>")
    judged = spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q3", "d")], "query_id STRING, chunk_id STRING")
    got = {r.query_id: (r.precision, r.recall) for r in quality.citation_scores(made, judged).collect()}
    assert got == {"q1": (0.5, 1.0), "q2": (0.0, 0.0), "q3": (0.0, 0.0)}
    cases = spark.createDataFrame([("c1", "answered", "abstained", "x", []), ("c2", "abstained", "answered", None, ["y"])], "case_id STRING, status STRING, expected_status STRING, answer STRING, acceptable_answers ARRAY<STRING>")
    assert {(r.code, r.case_id) for r in quality.answer_findings(cases).collect()} == {("false_answer", "c1"), ("unexpected_abstention", "c2"), ("answer_exact_mismatch", "c2")}
    assert {r.metric: r.value for r in quality.answer_observations(cases).collect()} == {"answer.status_accuracy": 0.0, "answer.exact_match_rate": 0.0, "safety.false_answer_rate": 1.0}


def test_findings_of_every_kind(spark):
    texts = spark.createDataFrame([("t1", True), ("t2", False)], "case_id STRING, exact_match BOOLEAN")
    cases = spark.createDataFrame([("q1", 0.0), ("q2", 0.5)], "query_id STRING, recall DOUBLE")
    made = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["c"])], "query_id STRING, chunk_ids ARRAY<STRING>")
    judged = spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q2", "d")], "query_id STRING, chunk_id STRING")
    results = spark.createDataFrame([("retrieval.mean_recall", "failed"), ("text.exact_match_rate", "passed")], "metric STRING, status STRING")
    reviews = spark.createDataFrame([("r", 2, 5, 5, 5), ("s", 3, 3, 3, 3)], "case_id STRING, relevance INT, correctness INT, completeness INT, traceability INT")
    parts = [quality.text_findings(texts), quality.retrieval_findings(cases), quality.citation_findings(quality.citation_scores(made, judged))]
    parts += [quality.gate_findings(results), quality.regression_findings(results), quality.low_reviews(reviews)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = [(r.dimension, r.case_id, r.code) for r in quality.ordered_findings(every).collect()]
    assert got == [
        ("human", "r", "low_human_review_score"), ("provenance", "q1", "citation_not_judged_relevant"), ("provenance", "q2", "relevant_evidence_not_cited"),
        ("regression", None, "quality_regression"), ("retrieval", None, "quality_gate_failed"), ("retrieval", "q1", "retrieval_zero_recall"), ("text", "t2", "text_mismatch"),
    ]
    assert {r.message for r in quality.gate_findings(results).collect()} == {"Quality gate failed for retrieval.mean_recall."}


def test_bounds_and_directions(spark):
    seen = spark.createDataFrame([("text.exact_match_rate", 1.1, 1), ("human.mean_relevance", 0.5, 1), ("cost.query_tokens", 1e9, 1), ("unknown", 0.0, 1), ("retrieval.mean_recall", None, 1)], "metric STRING, value DOUBLE, sample_count LONG")
    assert {r.metric for r in quality.out_of_bounds(seen).collect()} == {"text.exact_match_rate", "human.mean_relevance", "unknown", "retrieval.mean_recall"}
    assert quality.metric_table(spark).count() == 24


def test_canonical_json(spark):
    assert text.canonical_json({"b": 1e-05, "a": "é\x1b", "n": None}) == '{"a":"é\\u001b","b":1e-05,"n":null}'
    with pytest.raises(ValueError):
        text.canonical_json({"x": float("nan")})
    with pytest.raises(ValueError):
        text.strict_json('{"a":1,"a":2}')
    with pytest.raises(ValueError):
        text.strict_json("[NaN]")
    df = spark.sql("SELECT struct(1 AS b, 'x' AS a) AS s")
    assert df.select(text.canonical(df.s)).first()[0] == '{"a":"x","b":1}'


def test_events_and_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 3 else "b", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id LONG, t STRING, event_type STRING, value DOUBLE").selectExpr("event_id", "timestamp(t) ts", "event_type", "value")
    assert [r.event_id for r in events.event_page(df, 10, 3).collect()] == [11, 12, 13]
    assert events.purge(df, "2024-01-01 00:30:00").count() == 30
    folder = f"{tmp_path}/in"
    df.write.parquet(folder)
    q = stream.windowed_counts(stream.read_events(spark, folder), "10 minutes").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {tuple(r) for r in stream.windowed_counts(df, "10 minutes").collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want


MACHINE = (("new", "a", "on"), ("on", "b", "off"), ("off", "a", "on"), ("off", "b", "done"), ("on", "c", "new"))


def brute_states(rows):
    """States by one pass over each key's events in order."""
    goes, out = {(s, e): t for s, e, t in MACHINE}, {}
    for key, _, _, kind in sorted(set(rows), key=lambda r: (r[0], r[1], r[2])):
        state, n = out.get(key, ("new", 0))
        out[key] = (goes.get((state, kind), state), n + 1)
    return out


def test_states_are_folded_in_any_grouping(spark, tmp_path):
    import random

    random.seed(6)
    rows = [(random.randint(1, 5), f"2024-01-{random.randint(1, 9):02d} {random.randint(0, 23):02d}:00:00", k, random.choice("abcx")) for k in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame([(k, t, i, e) for k, t, i, e in rows] + [(None, "2024-01-01 00:00:00", 900, "a"), (1, None, 901, "a")], "user_id LONG, t STRING, event_id LONG, event_type STRING")
    df = df.selectExpr("user_id", "timestamp(t) ts", "event_id", "event_type", "'clash' AS state")
    want = brute_states(rows)
    for bucket in ("1 hour", "1 day", "30 days"):
        got = {r.user_id: (r.state, r.events) for r in events.folded_states(df, MACHINE, "new", bucket=bucket).collect()}
        assert got == want
    assert events.folded_states(df.limit(0), MACHINE, "new").count() == 0
    folder = f"{tmp_path}/in"
    for k, part in enumerate((df.filter("ts < '2024-01-05'"), df.filter("ts >= '2024-01-05' or ts is null"))):
        part.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream.state_stream(source, MACHINE, "new", late="30 days").writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("states").collect():
        last[r.user_id] = max(last.get(r.user_id, (0, "")), (r.events, r.state))
    assert {k: (s, n) for k, (n, s) in last.items()} == want
