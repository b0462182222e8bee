"""Scoring of rollout tables: one row per response, rule picked by data source.

Input columns: ``data_source``, ``response``, ``ground_truth`` and optionally ``pass_rate``. All
rules but the Python syntax check are native Columns; the check only receives code responses.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from rubrica.functions import fixed, rewards as r, text as t
from rubrica.session import once


def rule_of(source: Column, sources: dict[str, list[str]]) -> Column:
    """Name of the rule a data source belongs to, ``default`` for unknown ones."""
    branches = [F.when(source.isin(names), F.lit(rule)) for rule, names in sources.items()]
    return F.coalesce(*branches, F.lit("default"))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("_text", F.coalesce("response", F.lit("")))


def _pass_rate(df: DataFrame) -> Column | None:
    return F.col("pass_rate") if "pass_rate" in df.columns else None


def _numbers(df: DataFrame, normal: Callable[[Column], Column], number: Callable) -> DataFrame:
    """Stage the normalised answer and truth, then their numbers, one evaluation each."""
    truth = F.when(F.col("_answer").isNotNull(), F.coalesce("ground_truth", F.lit("")))
    df = df.withColumn("_bare", normal(F.col("_answer"))).withColumn("_want", normal(truth))
    return once(df, _num=number(F.col("_bare")), _wnum=number(F.col("_want")))


_STAGES = ("_text", "_rule", "_answer", "_bare", "_want", "_num", "_wnum", "_share")


def score_common(df: DataFrame, out: str = "score") -> DataFrame:
    """Common rule set: math (also the default), code, qa, format."""
    text, truth, rule = F.col("_text"), F.col("ground_truth"), F.col("_rule")
    staged = _text(df).withColumn("_rule", rule_of(F.col("data_source"), fixed.COMMON_SOURCES))
    staged = once(staged, _answer=F.when(rule.isin("math", "default"), r.common_answer(text)))
    staged = _numbers(staged, t.without_commas, t.to_float)
    numbers = (F.col("_num"), F.col("_wnum"))
    score = (
        F.when(rule == "code", r.code_reward(text, _pass_rate(df)))
        .when(rule == "qa", r.qa_reward(text, truth))
        .when(rule == "format", r.format_reward(text))
        .otherwise(r.math_reward(F.col("_answer"), truth, numbers=numbers))
    )
    return once(staged, **{out: score}).drop(*_STAGES)


def _staged(df: DataFrame, sources: dict[str, list[str]], answer: Callable) -> DataFrame:
    """Add _match (NULL without an answer), _share (qa only) and _parses (code only)."""
    rule, text = F.col("_rule"), F.col("_text")
    staged = _text(df).withColumn("_rule", rule_of(F.col("data_source"), sources))
    # one pass over all rows; only the texts of code rows leave the JVM
    staged = staged.withColumn("_parses", r.parses_as_python(F.when(rule == "code", text)))
    staged = once(
        staged,
        _answer=F.when(rule.isin("math", "default"), answer(text)),
        _share=F.when(rule == "qa", r.overlap_share(text, F.col("ground_truth"))),
    )
    staged = _numbers(staged, t.without_commas, t.finite_number)
    same = t.same_answer(F.col("_bare"), F.col("_want"), F.col("_num"), F.col("_wnum"))
    return staged.withColumn("_match", F.when(F.col("_answer").isNotNull(), same))


_GROUP_STAGES = (*_STAGES, "_parses", "_match")


def score_grpo(
    df: DataFrame, out: str = "score", correct: float = 1.0, mismatch: float = 0.1, wrong: float = 0.0
) -> DataFrame:
    """GRPO rule set. A mismatch earns the format score for math, nothing for unknown sources.

    An empty list of tests counts as no tests (``pass_rate`` NULL).
    """
    good, near, bad = (F.lit(float(v)) for v in (correct, mismatch, wrong))
    staged = _staged(df, fixed.GRPO_SOURCES, r.grpo_answer)
    text, truth, rule, match = (F.col(c) for c in ("_text", "ground_truth", "_rule", "_match"))
    tests = _pass_rate(df)
    code = F.when(F.col("_parses"), near if tests is None else F.coalesce(tests, near)).otherwise(bad)
    score = (
        F.when(rule == "code", code)
        .when(rule == "qa", r.banded(F.col("_share"), [(0.8, correct), (0.5, mismatch)], wrong))
        .when(rule == "label", r.label_reward(text, truth, correct, wrong))
        .when(match.isNull(), bad)
        .when(match, good)
        .when(rule == "math", near)
        .otherwise(bad)
    )
    return once(staged, **{out: score}).drop(*_GROUP_STAGES)


def score_gspo(
    df: DataFrame,
    out: str = "score",
    correct: float = 1.0,
    partial: float = 0.5,
    mismatch: float = 0.1,
    wrong: float = 0.0,
) -> DataFrame:
    """GSPO rule set: correctness plus the quality of the reasoning, at most 1.5."""
    good, near, bad = (F.lit(float(v)) for v in (correct, mismatch, wrong))
    staged = _staged(df, fixed.GSPO_SOURCES, r.gspo_answer)
    text, truth, rule, match = (F.col(c) for c in ("_text", "ground_truth", "_rule", "_match"))
    staged = once(staged, _quality=F.when(rule == "math", r.reasoning_quality(text)))
    quality = F.col("_quality")
    math = (
        F.when(match.isNull(), bad + quality * F.lit(0.5))
        .when(match, F.least(good + quality, F.lit(1.5)))
        .otherwise(near + quality)
    )
    bands = [(0.8, correct), (0.5, partial), (0.2, mismatch)]
    score = (
        F.when(rule == "math", math)
        .when(rule == "code", r.code_quality(text, F.col("_parses"), _pass_rate(df)))
        .when(rule == "qa", r.banded(F.col("_share"), bands, wrong))
        .when(rule == "dialogue", r.dialogue_reward(text, truth))
        .otherwise(F.when(match.isNull(), bad).when(match, good).otherwise(near))
    )
    return once(staged, **{out: score}).drop(*_GROUP_STAGES, "_quality")


def score_with_process(df: DataFrame, **rewards: float) -> DataFrame:
    """GRPO outcome, process reward and their sum; ``rewards`` go to the outcome's rule."""
    scored = score_grpo(df, "outcome_reward", **rewards)
    scored = once(scored, process_reward=r.process_reward(F.coalesce("response", F.lit(""))))
    return scored.withColumn("total_reward", F.col("outcome_reward") + F.col("process_reward"))


def score_with_length_penalty(
    df: DataFrame, out: str = "score", shortest: int = 20, longest: int = 2000, factor: float = 0.1
) -> DataFrame:
    """GRPO score less the length penalty, at least 0."""
    text = F.coalesce("response", F.lit(""))
    penalised = r.length_penalty(text, F.col("_base"), shortest, longest, factor)
    return once(score_grpo(df, "_base"), **{out: penalised}).drop("_base")


def score_composite(
    df: DataFrame, weights: dict[str, float] | None = None, out: str = "score"
) -> DataFrame:
    """Weighted mean of the common rewards math, code, qa, format and length."""
    weights = weights or {"math": 1.0}
    text, truth = F.coalesce("response", F.lit("")), F.col("ground_truth")
    staged = once(df, _answer=r.common_answer(text))
    rules = {
        "math": r.math_reward(F.col("_answer"), truth),
        "code": r.code_reward(text, _pass_rate(df)),
        "qa": r.qa_reward(text, truth),
        "format": r.format_reward(text),
        "length": r.length_penalty_reward(text),
    }
    return once(staged, **{out: r.weighted_mean(rules, weights)}).drop("_answer")


def pass_rates(results: DataFrame, by: str = "response_id") -> DataFrame:
    """Share of passed tests per response, from a table of test results (``passed`` boolean)."""
    passed = F.coalesce(F.col("passed").cast("int"), F.lit(0))
    return results.groupBy(by).agg(F.avg(passed).alias("pass_rate"), F.count("*").alias("tests"))


RewardRule = Callable[..., DataFrame]
_REWARDS: dict[str, RewardRule] = {
    "common": score_common,
    "grpo": score_grpo,
    "gspo": score_gspo,
    "length_penalty": score_with_length_penalty,
    "process": lambda df, out, **rewards: score_with_process(df, **rewards).withColumnRenamed("total_reward", out),
    "composite": lambda df, out, weights=None: score_composite(df, weights, out),
}


def register_reward(name: str, rule: RewardRule) -> None:
    """Make ``rule(df, out)`` available to ``score`` under a name."""
    _REWARDS[name] = rule


def score(df: DataFrame, reward: str = "grpo", out: str = "score", **kwargs) -> DataFrame:
    """Score with a registered reward; further arguments (``correct``, ``weights``, ...) are the rule's."""
    if reward not in _REWARDS:
        raise KeyError(f"unknown reward {reward!r}; known: {sorted(_REWARDS)}")
    return _REWARDS[reward](df, out, **kwargs)


def python_reward(
    fn: Callable, key: str | None = None, extra: str | None = "extra_info", **kwargs
) -> RewardRule:
    """Wrap ``fn(data_source, solution_str, ground_truth, extra_info=None, **kwargs)``.

    The function runs in Arrow batches next to the data. It may return a float, or a dict of
    floats of which ``key`` (default: ``score``) is taken. Native rules are far faster.
    """

    def rule(df: DataFrame, out: str = "score") -> DataFrame:
        @F.pandas_udf(DoubleType())
        def call(src: pd.Series, sol: pd.Series, truth: pd.Series, info: pd.Series) -> pd.Series:
            values = []
            for row in zip(src, sol, truth, info):
                value = fn(*row, **kwargs)
                values.append(float(value[key or "score"] if isinstance(value, dict) else value))
            return pd.Series(values, dtype="float64")

        info = F.col(extra) if extra and extra in df.columns else F.lit(None).cast("string")
        if dict(df.dtypes).get(extra or "", "").startswith("struct"):
            info = F.to_json(info)
        return df.withColumn(out, call("data_source", "response", "ground_truth", info))

    return rule
