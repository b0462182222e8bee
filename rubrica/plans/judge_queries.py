"""Judge queries: requests, replies, scores, cache, calls through a stub client."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.functions import judge, judge_prompts as jp
from rubrica.operators import judging
from rubrica.plans.inputs import cte, read, table
from rubrica.plans.sqltext import lit
from rubrica.session import fresh_path, spread
from rubrica.sources.scores import ScoreCache

_PRESET = """CASE data_source WHEN 'math_reasoning' THEN 'math' WHEN 'gsm8k' THEN 'math_plain'
 WHEN 'code' THEN 'code' WHEN 'dialogue' THEN 'dialogue' WHEN 'qa' THEN 'creative'
 WHEN 'classification' THEN 'safety' ELSE NULL END"""
_PROMPT = "'order ' || CAST(group_id AS STRING) || ' {response}'"
_TRUTH = "CASE WHEN line = 4 THEN NULL WHEN line = 5 THEN '' ELSE ground_truth END"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "rollouts").selectExpr(
        "group_id",
        "response_id",
        f"{_PRESET} AS preset",
        f"{_PROMPT} AS prompt",
        "response",
        f"{_TRUTH} AS ground_truth",
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the whole prompts and of the three providers' request bodies."""
    asked = judging.with_request(_asked(spark, sf))
    system, user = F.col("system"), F.col("user")
    return asked.select(
        "group_id",
        "response_id",
        F.md5("user").alias("user_digest"),
        F.length("user").cast("bigint").alias("user_length"),
        F.md5("body").alias("openai"),
        F.md5(judge.request_body("gemini", system, user, "judge")).alias("gemini"),
        F.md5(judge.request_body("claude", system, user, "judge")).alias("claude"),
    )


def _fill_sql(template: str) -> str:
    """Placeholders become column references; the prompt is filled in last, as it holds braces."""
    out = f"replace({lit(template)}, '{{response}}', chr(1))"
    for name, mark in (("ground_truth", 2), ("prompt", 3)):
        out = f"replace({out}, '{{{name}}}', chr({mark}))"
    for mark, value in ((3, "prompt"), (2, "shown"), (1, "response")):
        out = f"replace({out}, chr({mark}), {value})"
    return out


_TEMPLATES = {n: s for n, (_, s) in jp.PRESETS.items()} | {f"{n}_plain": s for n, s in jp.SCORING.items()}
_USER = (
    "CASE preset "
    + " ".join(f"WHEN '{n}' THEN {_fill_sql(s)}" for n, s in _TEMPLATES.items())
    + f" ELSE {_fill_sql(jp.DEFAULT_SCORING)} END"
)
_SYSTEM = (
    "CASE preset "
    + " ".join(f"WHEN '{n}' THEN {lit(s)}" for n, (s, _) in jp.PRESETS.items())
    + f" ELSE {lit(jp.DEFAULT_SYSTEM)} END"
)
_REQUESTS = f"""{cte('rollouts')}, a AS (SELECT group_id, response_id, response, {_PRESET} AS preset,
 {_PROMPT} AS prompt, CASE WHEN coalesce({_TRUTH}, '') = '' THEN '无' ELSE {_TRUTH} END AS shown FROM rollouts),
 u AS (SELECT *, {_USER} AS usr, {_SYSTEM} AS sys FROM a)
SELECT group_id, response_id, md5(usr) AS user_digest, length(usr) AS user_length,
 md5(json_object('model', 'judge', 'messages', [json_object('role', 'system', 'content', sys),
  json_object('role', 'user', 'content', usr)], 'temperature', 0e0, 'max_tokens', 256)::STRING) AS openai,
 md5(json_object('contents', [json_object('role', 'user', 'parts', [json_object('text', usr)])],
  'generationConfig', json_object('temperature', 0e0, 'maxOutputTokens', 256),
  'systemInstruction', json_object('parts', [json_object('text', sys)]))::STRING) AS gemini,
 md5(json_object('model', 'judge', 'max_tokens', 256, 'messages', [json_object('role', 'user', 'content', usr)],
  'temperature', 0e0, 'system', sys)::STRING) AS claude FROM u"""

#: Twelve shapes of judge replies; the number comes from the quantity.
_N = "CAST(CAST(l_quantity AS INT) % 13 AS STRING)"
_REPLY = f"""CASE CAST(l_partkey % 12 AS INT)
 WHEN 0 THEN '{{"score": ' || {_N} || ', "reason": "ok"}}'
 WHEN 1 THEN 'Here: {{"score": "' || {_N} || '"}} thanks'
 WHEN 2 THEN '{{"score": "8/' || {_N} || '"}}'
 WHEN 3 THEN '{{"reason": "none"}}'
 WHEN 4 THEN '{{score: ' || {_N} || '}}'
 WHEN 5 THEN 'I say ' || {_N} || ' of 10'
 WHEN 6 THEN '得分' || {_N} || '分'
 WHEN 7 THEN '{{"score": null}}'
 WHEN 8 THEN '{{"score": [7]}}'
 WHEN 9 THEN '{{"score": ' || {_N} || '.5}}'
 WHEN 10 THEN '{{"score": true}}'
 ELSE '' END"""
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Replies wrapped as each provider sends them, unwrapped, parsed and normalised."""
    lines = spread(read(spark, sf, "lineitem")).selectExpr(*_KEYS.split(", "), f"{_REPLY} AS content")
    text = F.col("content")
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(text).alias("message"))).alias("choices")))
    claude = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("content")))
    parts = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    gemini = F.to_json(F.struct(F.array(F.struct(parts.alias("content"))).alias("candidates")))
    rows = lines.select("*", openai.alias("openai"), claude.alias("claude"), gemini.alias("gemini"))
    rows = rows.withColumn("same", F.lit(True))
    for provider in ("openai", "claude", "gemini"):
        unwrapped = judge.reply_content(provider, F.col(provider))
        rows = rows.withColumn("same", F.col("same") & (unwrapped == text))
    return judging.parse_scores(rows).select(
        *_KEYS.split(", "),
        "same",
        "score",
        F.round(judge.normalize_score(F.col("score"), "linear", 0.1, 0.8), 6).alias("linear"),
        F.round(judge.normalize_score(F.col("score"), "sigmoid"), 6).alias("sigmoid"),
    )


_INT = "CAST(CAST(l_quantity AS INT) % 13 AS DOUBLE)"
_PARSED = f"""SELECT *, round(least(greatest(score * 8e-1 + 1e-1, 0e0), 1e0), 6) AS linear,
 round(1e0 / (1e0 + exp(-score)), 6) AS sigmoid FROM (
SELECT {_KEYS}, true AS same, CASE CAST(l_partkey % 12 AS INT)
 WHEN 0 THEN least(greatest({_INT}, 1e0), 10e0) / 10e0
 WHEN 1 THEN least(greatest({_INT}, 1e0), 10e0) / 10e0
 WHEN 2 THEN 8e-1
 WHEN 4 THEN CASE WHEN {_INT} BETWEEN 1 AND 10 THEN {_INT} / 10e0 ELSE 5e-1 END
 WHEN 5 THEN CASE WHEN {_INT} BETWEEN 1 AND 10 THEN {_INT} / 10e0 ELSE 5e-1 END
 WHEN 9 THEN least(greatest({_INT} + 5e-1, 1e0), 10e0) / 10e0
 WHEN 10 THEN 1e-1
 ELSE 5e-1 END AS score FROM lineitem)"""


def cache(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the first two responses are cached, some too old; what is left to ask, once each."""
    asked = judging.request_key(_asked(spark, sf).withColumn("line", F.expr("response_id div 100000000000000000")))
    known = asked.where("line <= 2").select(
        "request_key",
        (F.col("line") / F.lit(10.0)).alias("score"),
        F.when(F.col("group_id") % 3 == 0, F.lit(100.0)).otherwise(F.lit(9_000.0)).alias("scored_at"),
    )
    cached = judging.fresh(known, now=10_000.0, ttl=3600.0)
    left = judging.unscored(asked, cached)
    return left.select("preset", "prompt", "response", "ground_truth")


_CACHE = f"""{cte('rollouts')}, a AS (SELECT group_id, line, {_PRESET} AS preset, {_PROMPT} AS prompt, response,
 {_TRUTH} AS ground_truth FROM rollouts)
SELECT preset, prompt, response, any_value(ground_truth) AS ground_truth FROM a
GROUP BY group_id, preset, prompt, response, coalesce(ground_truth, '')
HAVING NOT bool_or(line <= 2 AND group_id % 3 <> 0)"""


def cached_scores(spark: SparkSession, sf: str) -> DataFrame:
    asked = judging.request_key(_asked(spark, sf).withColumn("line", F.expr("response_id div 100000000000000000")))
    known = asked.where("line <= 2").select(
        "request_key", (F.col("line") / F.lit(10.0)).alias("score"), F.lit(9_000.0).alias("scored_at")
    )
    out = judging.with_cached(asked, judging.fresh(known, now=10_000.0))
    return out.groupBy("line").agg(F.count("*").alias("n"), F.count("cached_score").alias("cached"))


_CACHED = f"""{cte('rollouts')}, a AS (SELECT group_id, line, coalesce({_PRESET}, '') AS preset, response,
 coalesce({_TRUTH}, '') AS truth FROM rollouts),
 k AS (SELECT DISTINCT group_id, preset, response, truth FROM a WHERE line <= 2)
SELECT line::BIGINT AS line, count(*) AS n, count(k.group_id) AS cached FROM a
LEFT JOIN k ON a.group_id = k.group_id AND a.preset = k.preset AND a.response = k.response AND a.truth = k.truth
GROUP BY line"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls through an injected client; this one answers by length and fails on some lengths."""

    def client(body: str) -> str:
        import json

        n = len(json.loads(body)["messages"][1]["content"])
        if n % 7 == 0:
            raise RuntimeError("no answer")
        return json.dumps({"choices": [{"message": {"content": json.dumps({"score": n % 10})}}]})

    asked = judging.with_request(_asked(spark, sf))
    answered = judging.call_judge(asked, client, tries=2, pause=0.0)
    return judging.judged(answered).select("group_id", "response_id", "score")


_CALLS = f"""{cte('rollouts')}, a AS (SELECT group_id, response_id, response, {_PRESET} AS preset,
 {_PROMPT} AS prompt, CASE WHEN coalesce({_TRUTH}, '') = '' THEN '无' ELSE {_TRUTH} END AS shown FROM rollouts),
 u AS (SELECT group_id, response_id, length({_USER}) AS n FROM a)
SELECT group_id, response_id, CASE WHEN n % 7 = 0 THEN 5e-1 ELSE greatest(n % 10, 1) / 10e0 END AS score FROM u"""

def cache_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of two runs over one cache: the second asks what failed in the first, and nothing else."""

    def client(body: str) -> str:
        import json

        n = len(json.loads(body)["messages"][1]["content"])
        if n % 7 == 0:
            raise RuntimeError("no answer")
        return json.dumps({"choices": [{"message": {"content": json.dumps({"score": n % 10})}}]})

    def second(body: str) -> str:
        return '{"choices": [{"message": {"content": "{\\"score\\": 10}"}}]}'

    store = ScoreCache(spark, fresh_path(spark, "scores"))
    asked = _asked(spark, sf)
    judging.score_with_cache(asked, store, client, now=1_000.0, tries=1, pause=0.0)
    store.compact(now=2_000.0)
    out = judging.score_with_cache(asked, store, second, now=2_000.0, tries=1, pause=0.0)
    return out.select("group_id", "response_id", "score")


_RUNS = _CALLS.replace("THEN 5e-1 ELSE", "THEN 1e0 ELSE")

QUERIES = {
    "judge_cache_runs": cache_runs,
    "judge_requests": requests,
    "judge_scores": parsed,
    "judge_unscored": cache,
    "judge_cached": cached_scores,
    "judge_calls": calls,
}

SQL = {
    "judge_cache_runs": _RUNS,
    "judge_requests": _REQUESTS,
    "judge_scores": _PARSED,
    "judge_unscored": _CACHE,
    "judge_cached": _CACHED,
    "judge_calls": _CALLS,
}
