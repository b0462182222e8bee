"""Scoring queries over the derived rollouts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.functions import fixed, rewards as r, text as t
from rubrica.operators import scoring
from rubrica.plans import sqltext as q
from rubrica.plans.inputs import cte, read, table
from rubrica.session import spread

KEYS = ["group_id", "response_id"]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("response")
    rows = table(spark, sf, "rollouts").withColumn("common_answer", r.common_answer(x))
    return rows.select(
        *KEYS,
        t.boxed_answer(x).alias("boxed"),
        t.marked_text(x, "####").alias("marked"),
        "common_answer",
        r.grpo_answer(x).alias("grpo_answer"),
        r.gspo_answer(x).alias("gspo_answer"),
        t.json_answer(x).isNotNull().alias("has_json"),
        t.normalize_number(F.col("common_answer")).alias("common_number"),
        F.size(t.words(x)).cast("bigint").alias("words"),
    )


_ANSWERS = f"""{cte('rollouts')}, a AS (SELECT *, {q.common_answer('response')} AS common_answer FROM rollouts)
SELECT group_id, response_id, {q.boxed('response')} AS boxed, {q.marked_text('response', '####')} AS marked,
 common_answer,
 coalesce({q.boxed('response')}, {q.marked_number('response', fixed.GRPO_MARKERS)}) AS grpo_answer,
 coalesce({q.boxed('response')}, {q.marked_number('response', fixed.GSPO_MARKERS)}) AS gspo_answer,
 coalesce(json_valid({q.last_object('response')}), false) AS has_json,
 {q.number('common_answer')} AS common_number,
 len({q.words('response')})::BIGINT AS words
FROM a"""


def scores(reward: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        scored = scoring.score(table(spark, sf, "rollouts"), reward)
        return scored.select(*KEYS, "data_source", "score")

    return query


_COMMON = f"""CASE WHEN {q.in_list('data_source', fixed.COMMON_SOURCES['code'])} THEN {q.code('response')}
 WHEN {q.in_list('data_source', fixed.COMMON_SOURCES['qa'])} THEN {q.qa('response', 'ground_truth')}
 WHEN {q.in_list('data_source', fixed.COMMON_SOURCES['format'])} THEN {q.json_format('response')}
 ELSE {q.math(q.common_answer('response'), 'ground_truth')} END"""


def _scores_sql(expr: str) -> str:
    return f"{cte('rollouts')} SELECT group_id, response_id, data_source, {expr} AS score FROM rollouts"


def process_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_with_process(table(spark, sf, "rollouts"))
    return scored.select(*KEYS, "outcome_reward", "process_reward", "total_reward")


_PROCESS = f"""{cte('rollouts')}, s AS (SELECT group_id, response_id, {q.grpo()} AS outcome_reward,
 {q.process('response')} AS process_reward FROM rollouts)
SELECT *, outcome_reward + process_reward AS total_reward FROM s"""


def composite_scores(spark: SparkSession, sf: str) -> DataFrame:
    weights = {"math": 0.5, "format": 0.2, "length": 0.2, "unknown": 0.1}
    scored = scoring.score_composite(table(spark, sf, "rollouts"), weights)
    model = F.col("score") * F.lit(0.5)
    text = F.col("response")
    return scored.select(
        *KEYS,
        F.round("score", 6).alias("score"),
        F.round(r.model_rule_reward(model, text), 6).alias("model_rule"),
    )


_LENGTH = q.length_penalty("response", "1e0", 50, 2000)
_MARKERS = q.has_any("response", fixed.REQUIRED_MARKERS)
_COMPOSITE = f"""{cte('rollouts')}, s AS (SELECT *, (0e0 + {q.math(q.common_answer('response'), 'ground_truth')} * 5e-1
 + {q.json_format('response')} * 2e-1 + {_LENGTH} * 2e-1) / 1e0 AS raw FROM rollouts)
SELECT group_id, response_id, round(raw, 6) AS score,
 round(raw * 5e-1 * 7e-1 + ({_LENGTH} + CASE WHEN {_MARKERS} THEN 1e-1 ELSE 0e0 END) * 3e-1, 6) AS model_rule
FROM s"""


def format_checks(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("text")
    return spread(read(spark, sf, "documents")).select(
        "doc_id",
        r.format_reward(x, "json").alias("json"),
        r.format_reward(x, "markdown").alias("markdown"),
        r.format_reward(x, "steps").alias("steps"),
        F.round(r.length_penalty_reward(x), 6).alias("length_reward"),
        r.code_reward(x).alias("code"),
        F.round(r.reasoning_quality(x), 6).alias("quality"),
    )


_FORMAT = f"""SELECT doc_id, {q.json_format('text')} AS json,
 CASE WHEN {q.any_of('text', fixed.MARKDOWN)} THEN 1e0 ELSE 0e0 END AS markdown,
 CASE WHEN {q.any_of('text', fixed.STEP_FORMATS)} THEN 1e0 ELSE 0e0 END AS steps,
 round({q.length_penalty('text', '1e0', 50, 2000)}, 6) AS length_reward, {q.code('text')} AS code,
 round({q.quality('text')}, 6) AS quality
FROM documents"""


def reply_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """QA reward of each turn against the turn before it; turns meet on (conversation, turn)."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    pairs = turns.join(before, ["conv_id", "turn"])
    return pairs.select(
        "conv_id", "turn", F.round(r.qa_reward(F.col("text"), F.col("truth")), 6).alias("score")
    )


_OVERLAP = f"""SELECT a.conv_id, a.turn, round({q.qa('a.text', 'b.text')}, 6) AS score
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1"""


def tested_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Code responses with a table of test results: pass rates joined in, then all rule sets."""
    code = table(spark, sf, "rollouts").where("data_source = 'code'")
    results = code.select(
        F.concat_ws("-", *KEYS).alias("key"),
        F.explode(F.sequence(F.lit(1), F.lit(4))).alias("test_id"),
        "line",
    ).select("key", (F.col("test_id") <= F.col("line")).alias("passed"))
    rates = scoring.pass_rates(results, "key")
    tested = code.withColumn("key", F.concat_ws("-", *KEYS)).join(rates, "key")
    out = scoring.score_common(tested, "common")
    out = scoring.score_grpo(out, "grpo")
    out = scoring.score_gspo(out, "gspo")
    return out.select(*KEYS, "pass_rate", "tests", "common", "grpo", F.round("gspo", 6).alias("gspo"))


_QUARTERS = "least(line, 4) / 4e0"
_TESTED = f"""{cte('rollouts')} SELECT group_id, response_id, {_QUARTERS} AS pass_rate, 4::BIGINT AS tests,
 {_QUARTERS} AS common, CASE WHEN {q.PARSES} THEN {_QUARTERS} ELSE 0e0 END AS grpo,
 round(least(1e0, {q.gspo()} + CASE WHEN {q.PARSES} THEN {_QUARTERS} * 3e-1 ELSE 0e0 END), 6) AS gspo
FROM rollouts WHERE data_source = 'code'"""


def custom_reward(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own Python scoring function, registered by name and run in Arrow batches."""

    def compute_score(data_source, solution_str, ground_truth, extra_info=None, bonus=0.0):
        return 1.0 + bonus if ground_truth in solution_str else 0.0

    scoring.register_reward("contains_truth", scoring.python_reward(compute_score, bonus=0.5))
    scored = scoring.score(table(spark, sf, "rollouts"), "contains_truth")
    return scored.select(*KEYS, "score")


_CUSTOM = f"""{cte('rollouts')} SELECT group_id, response_id,
 CASE WHEN contains(response, ground_truth) THEN 15e-1 ELSE 0e0 END AS score FROM rollouts"""


def source_rules(spark: SparkSession, sf: str) -> DataFrame:
    src = F.col("data_source")
    rules = table(spark, sf, "rollouts").select(
        "data_source",
        scoring.rule_of(src, fixed.COMMON_SOURCES).alias("common"),
        scoring.rule_of(src, fixed.GRPO_SOURCES).alias("grpo"),
        scoring.rule_of(src, fixed.GSPO_SOURCES).alias("gspo"),
    )
    return rules.groupBy("data_source", "common", "grpo", "gspo").agg(F.count("*").alias("n"))


def _rule_sql(sources: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN {q.in_list('data_source', v)} THEN {q.lit(k)}" for k, v in sources.items())
    return f"CASE {whens} ELSE 'default' END"


_RULES = f"""{cte('rollouts')} SELECT data_source, {_rule_sql(fixed.COMMON_SOURCES)} AS common,
 {_rule_sql(fixed.GRPO_SOURCES)} AS grpo, {_rule_sql(fixed.GSPO_SOURCES)} AS gspo, count(*) AS n
FROM rollouts GROUP BY ALL"""


QUERIES = {
    "answer_extraction": answers,
    "scores_common": scores("common"),
    "scores_grpo": scores("grpo"),
    "scores_gspo": scores("gspo"),
    "scores_length_penalty": scores("length_penalty"),
    "scores_process": process_scores,
    "scores_composite": composite_scores,
    "scores_tested_code": tested_scores,
    "scores_custom_function": custom_reward,
    "source_dispatch": source_rules,
    "document_format_checks": format_checks,
    "reply_overlap": reply_overlap,
}

SQL = {
    "answer_extraction": _ANSWERS,
    "scores_common": _scores_sql(_COMMON),
    "scores_grpo": _scores_sql(q.grpo()),
    "scores_gspo": _scores_sql(q.gspo()),
    "scores_length_penalty": _scores_sql(q.length_penalty("response", f"({q.grpo()})", 20, 2000)),
    "scores_process": _PROCESS,
    "scores_composite": _COMPOSITE,
    "scores_tested_code": _TESTED,
    "scores_custom_function": _CUSTOM,
    "source_dispatch": _RULES,
    "document_format_checks": _FORMAT,
    "reply_overlap": _OVERLAP,
}
