"""Rule rewards as native Columns, in three rule sets: common, grpo and gspo.

Each rule takes Columns and returns a double. ``operators.scoring`` lays them out over a rollout
table so that an extracted answer is computed once per row.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType

from rubrica.functions import fixed, text as t


def _d(value: float) -> Column:
    return F.lit(float(value))


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


# --- answers -----------------------------------------------------------------------------------


def common_answer(solution: Column) -> Column:
    found = [t.marked_text(solution, m) for m in fixed.COMMON_MARKERS]
    return F.coalesce(t.boxed_answer(solution), *found)


def grpo_answer(solution: Column) -> Column:
    return F.coalesce(t.boxed_answer(solution), t.marked_number(solution, fixed.GRPO_MARKERS))


def gspo_answer(solution: Column) -> Column:
    return F.coalesce(t.boxed_answer(solution), t.marked_number(solution, fixed.GSPO_MARKERS))


# --- common rules ------------------------------------------------------------------------------


def math_reward(
    answer: Column,
    truth: Column,
    correct: float = 1.0,
    mismatch: float = 0.0,
    wrong: float = 0.0,
    numbers: tuple[Column, Column] | None = None,
) -> Column:
    """Score of an extracted answer: numbers within 1e-6, otherwise equal text.

    ``numbers`` takes the two normalised numbers where they are columns already.
    """
    given, wanted = numbers or (t.normalize_number(answer), t.normalize_number(truth))
    numeric = given.isNotNull() & wanted.isNotNull()
    same_text = F.lower(t.strip(answer)) == F.lower(t.strip(F.coalesce(truth, F.lit(""))))
    equal = F.when(numeric, F.abs(given - wanted) < 1e-6).otherwise(same_text)
    return F.when(answer.isNull(), _d(wrong)).when(equal, _d(correct)).otherwise(_d(mismatch))


def code_reward(solution: Column, pass_rate: Column | None = None) -> Column:
    """Share of passed tests where there are any, else 0.5 for a function or class."""
    heuristic = F.when(t.contains_any(solution, ["def ", "class "]), _d(0.5)).otherwise(_d(0.0))
    return heuristic if pass_rate is None else F.coalesce(pass_rate, heuristic)


def qa_reward(solution: Column, truth: Column, exact: bool = False) -> Column:
    said = F.lower(t.strip(solution))
    want = F.lower(t.strip(F.coalesce(truth, F.lit(""))))
    if exact:
        return (said == want).cast("double")
    return F.when(F.contains(said, want), _d(1.0)).otherwise(t.word_overlap(want, said))


def format_reward(solution: Column, required: str = "json") -> Column:
    if required == "json":
        inner = t.last_object(solution)
        embedded = F.try_parse_json(inner).isNotNull() & ~inner.rlike(r"^\{\s*\}$")
        return (
            F.when(t.is_json(solution), _d(1.0))
            .when(embedded, _d(0.5))
            .otherwise(_d(0.0))
        )
    patterns = {"markdown": fixed.MARKDOWN, "steps": fixed.STEP_FORMATS}.get(required)
    if patterns is None:
        return _d(0.0)
    return t.matches_any(solution, patterns).cast("double")


def length_penalty(
    solution: Column, base: Column, shortest: int, longest: int, factor: float = 0.1
) -> Column:
    """``base`` less a penalty that grows with the distance from the length range, at least 0."""
    n = F.length(solution).cast("double")
    penalty = (
        F.when(n < shortest, (_d(shortest) - n) / _d(shortest) * _d(factor))
        .when(n > longest, (n - _d(longest)) / _d(longest) * _d(factor))
        .otherwise(_d(0.0))
    )
    return F.greatest(_d(0.0), base - penalty)


def length_penalty_reward(
    solution: Column, base: float = 1.0, shortest: int = 50, longest: int = 2000, factor: float = 0.1
) -> Column:
    """Unlike a penalised score, the base is returned untouched inside the range."""
    n = F.length(solution)
    return F.when(n.between(shortest, longest), _d(base)).otherwise(
        length_penalty(solution, _d(base), shortest, longest, factor)
    )


def weighted_mean(rewards: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean. A weight without a reward counts in the divisor; 0 if weights sum to <= 0."""
    total = sum(weights.values())
    if total <= 0:
        return _d(0.0)
    used = [rewards[name] * _d(w) for name, w in weights.items() if name in rewards]
    return _add([_d(0.0), *used]) / _d(total)


def marker_bonus(solution: Column) -> Column:
    has = t.contains_any(solution, fixed.REQUIRED_MARKERS)
    return F.when(has, _d(fixed.MARKER_BONUS)).otherwise(_d(0.0))


def model_rule_reward(model_score: Column, solution: Column) -> Column:
    """Weighted mean of a model score and a rule score (length penalty plus marker bonus)."""
    rule = length_penalty_reward(solution) + marker_bonus(solution)
    parts = {"rm_score": model_score, "rule_score": rule}
    return weighted_mean(parts, fixed.MODEL_RULE_WEIGHTS)


# --- grpo and gspo rules -----------------------------------------------------------------------


def overlap_share(solution: Column, truth: Column) -> Column:
    """1 if the truth is part of the text, else the share of its words found there."""
    said = t.strip(F.lower(solution))
    want = t.strip(F.lower(F.coalesce(truth, F.lit(""))))
    return F.when(F.contains(said, want), _d(1.0)).otherwise(t.word_overlap(want, said))


def banded(share: Column, bands: list[tuple[float, float]], low: float) -> Column:
    """Score of the first band the share exceeds."""
    score = F.when(share.isNull(), None)
    for above, value in bands:
        score = score.when(share > above, _d(value))
    return score.otherwise(_d(low))


def label_reward(solution: Column, truth: Column, correct: float = 1.0, wrong: float = 0.0) -> Column:
    said, want = F.lower(solution), F.lower(truth)
    hit = want.isin(fixed.GRPO_LABELS) & F.contains(said, want)
    return F.when(hit, _d(correct)).otherwise(_d(wrong))


def process_reward(solution: Column) -> Column:
    """Bonus for visible steps and arithmetic, at most 0.3."""
    kinds = _add([solution.rlike(p).cast("int") for p in fixed.GRPO_STEPS])
    steps = F.when(kinds >= 2, _d(0.2)).when(kinds >= 1, _d(0.1)).otherwise(_d(0.0))
    sums = F.when(solution.rlike(fixed.ARITHMETIC), _d(0.1)).otherwise(_d(0.0))
    return F.least(steps + sums, _d(0.3))


def reasoning_quality(solution: Column) -> Column:
    """Bonus for step words, calculations and explanations, at most 0.5."""
    hits = _add([F.regexp_count(solution, F.lit(p)) for p in fixed.GSPO_STEPS])
    steps = (
        F.when(hits >= 4, _d(0.3)).when(hits >= 2, _d(0.2)).when(hits >= 1, _d(0.1)).otherwise(_d(0.0))
    )
    sums = F.when(t.matches_any(solution, fixed.GSPO_CALCULATION), _d(0.1)).otherwise(_d(0.0))
    why = t.contains_any(F.lower(solution), fixed.GSPO_EXPLANATIONS)
    return F.least(steps + sums + F.when(why, _d(0.1)).otherwise(_d(0.0)), _d(0.5))


def code_quality(solution: Column, parses: Column, pass_rate: Column | None = None) -> Column:
    """Points for a function, a docstring, a return type, valid syntax and passed tests."""

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, _d(value)).otherwise(_d(0.0))

    tests = _d(0.0) if pass_rate is None else F.coalesce(pass_rate, _d(0.0)) * _d(0.3)
    total = (
        points(solution.rlike(fixed.GSPO_FUNCTION), 0.2)
        + points(t.matches_any(solution, fixed.GSPO_DOCSTRINGS), 0.1)
        + points(solution.rlike(fixed.GSPO_RETURN_TYPE), 0.1)
        + points(parses, 0.3)
        + F.when(parses, tests).otherwise(_d(0.0))
    )
    return F.least(total, _d(1.0))


def dialogue_reward(solution: Column, truth: Column) -> Column:
    """Points for a fitting length, a polite word, and any of the first five words of the truth."""
    n, said = F.length(solution), F.lower(solution)
    size = F.when(n.between(50, 500), _d(0.3)).when(n.between(20, 1000), _d(0.2)).otherwise(_d(0.0))
    polite = F.when(t.contains_any(said, fixed.GSPO_POLITE), _d(0.1)).otherwise(_d(0.0))
    first = F.split(t.strip(F.lower(F.coalesce(truth, F.lit("")))), f"{fixed.S}+", 6)
    words = [F.nullif(F.get(first, F.lit(i)), F.lit("")) for i in range(5)]
    related = reduce(lambda a, b: a | b, [F.coalesce(F.contains(said, w), F.lit(False)) for w in words])
    return F.least(size + polite + F.when(related, _d(0.3)).otherwise(_d(0.0)), _d(1.0))


@F.pandas_udf(BooleanType())
def parses_as_python(source: pd.Series) -> pd.Series:
    """Whether each text compiles as Python. Nothing is ever executed. NULL stays NULL."""
    import warnings

    def check(code: str | None) -> bool | None:
        if code is None:
            return None
        try:
            compile(code, "<text>", "exec", dont_inherit=True)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
            return False

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return source.map(check, na_action=None).astype("object")
