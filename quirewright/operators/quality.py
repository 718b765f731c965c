"""Quality: observations from cases, findings, gates and regressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every metric with its direction (1 rising, -1 falling, 0 neither) and its bounds.
METRICS = """
text.exact_match_rate 1 0 1
text.mean_character_error_rate -1 0 -
text.mean_word_error_rate -1 0 -
retrieval.mean_reciprocal_rank 1 0 1
retrieval.mean_precision 1 0 1
retrieval.mean_recall 1 0 1
retrieval.mean_average_precision 1 0 1
retrieval.mean_ndcg 1 0 1
answer.status_accuracy 1 0 1
answer.exact_match_rate 1 0 1
provenance.citation_precision 1 0 1
provenance.citation_recall 1 0 1
provenance.supported_answer_rate 1 0 1
safety.false_answer_rate -1 0 1
cost.query_tokens 0 0 -
cost.retrieved_characters 0 0 -
cost.answer_characters 0 0 -
cost.evidence_characters 0 0 -
cost.external_requests -1 0 -
cost.estimated_external_usd -1 0 -
human.mean_relevance 1 1 5
human.mean_correctness 1 1 5
human.mean_completeness 1 1 5
human.mean_traceability 1 1 5
"""
TABLE = [(m, int(d), float(low), None if high == "-" else float(high)) for m, d, low, high in (x.split() for x in METRICS.strip().split("\n"))]

# Findings, their severity and message.
FINDINGS = {
    "text_mismatch": ("warning", "Predicted text does not exactly match the reference."),
    "retrieval_zero_recall": ("warning", "No judged relevant chunk was retrieved at the configured cutoff."),
    "citation_not_judged_relevant": ("warning", "The answer cites a chunk not judged relevant for this case."),
    "relevant_evidence_not_cited": ("warning", "The answer omits at least one judged relevant chunk."),
    "false_answer": ("error", "The system answered a case expected to abstain."),
    "unexpected_abstention": ("error", "The system abstained from a case expected to be answered."),
    "answer_exact_mismatch": ("warning", "Answer text is outside the case's accepted exact-answer set."),
    "low_human_review_score": ("warning", "At least one human-review rubric score is 2 or lower."),
    "quality_gate_failed": ("error", "Quality gate failed for "),
    "quality_regression": ("error", "Metric regressed beyond tolerance: "),
}


def metric_table(spark) -> DataFrame:
    """(metric, direction, lower, upper) of every metric; a null upper bound is none."""
    return spark.createDataFrame(TABLE, "metric STRING, direction INT, lower DOUBLE, upper DOUBLE")


def _finding(code: str, dimension: str | Column, case: Column | None = None, more: Column | None = None) -> list[Column]:
    """The columns of a finding: code, severity, dimension, case_id, message."""
    severity, message = FINDINGS[code]
    text = F.lit(message) if more is None else F.concat(F.lit(message), more, F.lit("."))
    return [
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(dimension) if isinstance(dimension, str) else dimension).alias("dimension"),
        (F.lit(None).cast("string") if case is None else case).alias("case_id"), text.alias("message"),
    ]


def observed(df: DataFrame, dimension: str, values: dict[str, Column], samples: Column | None = None) -> DataFrame:
    """(metric, value, sample_count): aggregates of ``df``; none where ``df`` has no rows."""
    n = F.count("*") if samples is None else samples
    row = df.agg(n.alias("_n"), *(v.cast("double").alias(k) for k, v in values.items()))
    pairs = F.array(*(F.struct(F.lit(f"{dimension}.{k}").alias("metric"), F.col(k).alias("value")) for k in values))
    return row.filter("_n > 0").select("_n", F.explode(pairs).alias("p")).select(
        "p.metric", F.round("p.value", 12).alias("value"), F.col("_n").alias("sample_count")
    )


def text_observations(cases: DataFrame) -> DataFrame:
    return observed(cases, "text", {
        "exact_match_rate": F.avg(F.col("exact_match").cast("double")),
        "mean_character_error_rate": F.avg("character_error_rate"),
        "mean_word_error_rate": F.avg("word_error_rate"),
    })


def retrieval_observations(cases: DataFrame) -> DataFrame:
    """Pooled over all cases."""
    return observed(cases, "retrieval", {f"mean_{m}": F.avg(m) for m in ("reciprocal_rank", "precision", "recall", "average_precision", "ndcg")})


def citation_scores(answers: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query_id, cited, relevant, both, precision, recall) of every judged query; nothing cited gives precision 0.

    answers: query_id, chunk_ids (cited, repeats count once); judgments: query_id, chunk_id.
    """
    wanted = judgments.groupBy("query_id").agg(F.collect_set("chunk_id").alias("wanted"))
    rows = wanted.join(answers.select("query_id", F.array_distinct("chunk_ids").alias("cited")), "query_id", "left")
    rows = rows.withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))
    both = F.size(F.array_intersect("cited", "wanted"))
    return rows.select(
        "query_id",
        F.size("cited").alias("cited"),
        F.size("wanted").alias("relevant"),
        F.when(F.size("cited") > 0, both / F.size("cited")).otherwise(0.0).alias("precision"),
        (both / F.size("wanted")).alias("recall"),
        both.alias("both"),
    )


def provenance_observations(scores: DataFrame) -> DataFrame:
    return observed(scores, "provenance", {"citation_precision": F.avg("precision"), "citation_recall": F.avg("recall")})


def answer_observations(cases: DataFrame) -> DataFrame:
    """cases: status, expected_status, answer, acceptable_answers (array, may be empty)."""
    status = observed(cases, "answer", {"status_accuracy": F.avg((F.col("status") == F.col("expected_status")).cast("double"))})
    exact = F.coalesce(F.array_contains("acceptable_answers", F.col("answer")), F.lit(False))
    matched = observed(cases.filter(F.size("acceptable_answers") > 0), "answer", {"exact_match_rate": F.avg(exact.cast("double"))})
    silent = cases.filter("expected_status = 'abstained'")
    wrong = observed(silent, "safety", {"false_answer_rate": F.avg((F.col("status") == "answered").cast("double"))})
    return status.unionByName(matched).unionByName(wrong)


def supported_observations(audit: DataFrame) -> DataFrame:
    """The rate of answers all of whose citations hold; audit: answer_id or query_id, supported."""
    return observed(audit, "provenance", {"supported_answer_rate": F.avg(F.col("supported").cast("double"))})


def cost_observations(answers: DataFrame, terms: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Characters and tokens, each time they occur, that answering took; nothing external is asked."""
    sizes = hits.join(chunks.select("chunk_id", F.length("text").alias("_n")).dropDuplicates(["chunk_id"]), "chunk_id").groupBy("query_id").agg(F.sum("_n").alias("retrieved"))
    rows = answers.join(terms.select("query_id", F.col("token_count").alias("words")), "query_id").join(sizes, "query_id", "left")
    excerpts = F.aggregate("citations", F.lit(0), lambda a, c: a + F.length(c.excerpt))
    return observed(rows, "cost", {
        "query_tokens": F.sum("words"), "retrieved_characters": F.sum(F.coalesce("retrieved", F.lit(0))),
        "answer_characters": F.sum(F.coalesce(F.length("answer"), F.lit(0))), "evidence_characters": F.sum(excerpts),
        "external_requests": F.sum(F.lit(0)), "estimated_external_usd": F.sum(F.lit(0.0)),
    })


def review_observations(reviews: DataFrame) -> DataFrame:
    return observed(reviews, "human", {f"mean_{c}": F.avg(c) for c in ("relevance", "correctness", "completeness", "traceability")})


def text_findings(cases: DataFrame) -> DataFrame:
    """The cases (case_id, exact_match) whose text differs."""
    return cases.filter(~F.col("exact_match")).select(*_finding("text_mismatch", "text", F.col("case_id")))


def retrieval_findings(cases: DataFrame) -> DataFrame:
    """The cases (query_id, recall) of which nothing was retrieved."""
    return cases.filter("recall = 0").select(*_finding("retrieval_zero_recall", "retrieval", F.col("query_id")))


def citation_findings(scores: DataFrame) -> DataFrame:
    """From ``citation_scores``: answers that cite what isn't judged relevant, and that leave out what is."""
    wrong = scores.filter("cited > both").select(*_finding("citation_not_judged_relevant", "provenance", F.col("query_id")))
    left = scores.filter("relevant > both").select(*_finding("relevant_evidence_not_cited", "provenance", F.col("query_id")))
    return wrong.unionByName(left)


def answer_findings(cases: DataFrame) -> DataFrame:
    """What is wrong with answers. cases: case_id, status, expected_status, answer, acceptable_answers (array, may be empty)."""
    answered, expected = F.col("status") == "answered", F.col("expected_status") == "answered"
    exact = F.coalesce(F.array_contains("acceptable_answers", F.col("answer")), F.lit(False))
    kinds = (
        (answered & ~expected, "false_answer", "safety"),
        (~answered & expected, "unexpected_abstention", "safety"),
        ((F.size("acceptable_answers") > 0) & ~exact, "answer_exact_mismatch", "answer"),
    )
    found = F.array_compact(F.array(*(F.when(when, F.struct(*_finding(code, dimension, F.col("case_id")))) for when, code, dimension in kinds)))
    return cases.select(F.explode(found).alias("f")).select("f.*")


def low_reviews(reviews: DataFrame, at_most: int = 2) -> DataFrame:
    worst = F.least("relevance", "correctness", "completeness", "traceability")
    return reviews.filter(worst <= at_most).select(*_finding("low_human_review_score", "human", F.col("case_id")))


def gate_findings(results: DataFrame) -> DataFrame:
    """The gates that failed."""
    return results.filter("status = 'failed'").select(*_finding("quality_gate_failed", F.substring_index("metric", ".", 1), more=F.col("metric")))


def regression_findings(results: DataFrame) -> DataFrame:
    """The rules that failed."""
    return results.filter("status = 'failed'").select(*_finding("quality_regression", "regression", more=F.col("metric")))


def direction(metric: Column) -> Column:
    rising, falling = ([m for m, d, _, _ in TABLE if d == sign] for sign in (1, -1))
    return F.when(metric.isin(*rising), 1).when(metric.isin(*falling), -1).otherwise(0)


def out_of_bounds(observations: DataFrame) -> DataFrame:
    """Observations of no known metric, or outside its bounds."""
    joined = observations.join(F.broadcast(metric_table(observations.sparkSession)), "metric", "left")
    inside = (F.col("value") >= F.col("lower")) & (F.col("upper").isNull() | (F.col("value") <= F.col("upper")))
    return joined.filter(~F.coalesce(inside, F.lit(False))).select(*observations.columns)


def gates(rules: DataFrame, observations: DataFrame) -> DataFrame:
    """Each gate with its value and status; a missing metric or too few samples isn't evaluated, and gives no value.

    rules: metric, comparator (minimum or maximum), threshold, minimum_samples.
    """
    joined = rules.join(observations, "metric", "left")
    passed = F.when(F.col("comparator") == "minimum", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    known = F.coalesce(F.col("sample_count") >= F.col("minimum_samples"), F.lit(False)) & F.col("value").isNotNull()
    status = F.when(~known, "not_evaluated").when(passed, "passed").otherwise("failed")
    return joined.withColumns(
        {"status": status, "value": F.when(known, F.col("value")), "sample_count": F.when(known, F.col("sample_count")).otherwise(0)}
    )


def regressions(rules: DataFrame, current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each rule with the loss against the baseline; null where it isn't evaluated.

    rules: metric, maximum_degradation, minimum_samples. A metric without a direction can't degrade and isn't evaluated.
    """
    old = baseline.select("metric", F.col("value").alias("baseline"), F.col("sample_count").alias("baseline_samples"))
    joined = rules.join(current, "metric", "left").join(old, "metric", "left")
    sign = direction(F.col("metric"))
    loss = F.round((F.col("baseline") - F.col("value")) * sign, 12)
    known = F.coalesce(F.least("sample_count", "baseline_samples") >= F.col("minimum_samples"), F.lit(False)) & loss.isNotNull() & (sign != 0)
    known = known & F.col("sample_count").isNotNull() & F.col("baseline_samples").isNotNull()
    status = F.when(~known, "not_evaluated").when(loss <= F.col("maximum_degradation"), "passed").otherwise("failed")
    out = {"degradation": F.when(known, loss), "status": status}
    out |= {c: F.when(known, F.col(c)) for c in ("value", "baseline")} | {c: F.when(known, F.col(c)).otherwise(0) for c in ("sample_count", "baseline_samples")}
    return joined.withColumns(out)


def report_status(*results: DataFrame) -> DataFrame:
    """One row: failed, else incomplete, else passed; observational without any result."""
    every = reduce(DataFrame.unionByName, (r.select("status") for r in results))
    failed, missing = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "not_evaluated")
    return every.agg(
        F.when(failed > 0, "failed").when(missing > 0, "incomplete").when(F.count("*") > 0, "passed").otherwise("observational").alias("status")
    )


def suite_violations(answer_cases: DataFrame, text_cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """(case_id, violation): case ids used twice, and reviews of cases that don't exist."""
    ids = answer_cases.select("case_id").unionByName(text_cases.select("case_id"))
    twice = ids.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("duplicate_case").alias("violation"))
    lost = reviews.select("case_id").distinct().join(answer_cases.select("case_id"), "case_id", "left_anti")
    return twice.unionByName(lost.select("case_id", F.lit("unknown_case").alias("violation")))


def ordered_observations(observations: DataFrame) -> DataFrame:
    """A report's metrics by name."""
    return observations.orderBy("metric")


def ordered_findings(findings: DataFrame) -> DataFrame:
    """A report's findings by dimension, case, code and message."""
    return findings.orderBy("dimension", F.coalesce("case_id", F.lit("")), "code", "message")
