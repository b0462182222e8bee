"""Judge requests and replies as native Columns: prompts, provider bodies, score parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from rubrica.functions import judge_prompts as jp, text as t

#: Shown where there is no reference answer.
NO_TRUTH = "无"
#: Score of a reply that says nothing usable, and of a failed call.
DEFAULT_SCORE = 0.5
MAX_TOKENS = 256


def fill(template: str, **values: Column) -> Column:
    """Template with ``{name}`` replaced by Columns. Other braces, and braces inside the values,
    are left alone."""
    names = "|".join(values)
    parts = re.split(rf"\{{({names})\}}", template)
    cols = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*cols)


def _filled(template: str, prompt: Column, response: Column, truth: Column) -> Column:
    shown = F.when(F.coalesce(truth, F.lit("")) == "", F.lit(NO_TRUTH)).otherwise(truth)
    text = {"prompt": F.coalesce(prompt, F.lit("")), "response": F.coalesce(response, F.lit(""))}
    return fill(template, ground_truth=shown, **text)


def system_prompt(preset: Column) -> Column:
    """System prompt of a preset name; the default for unknown names and NULL."""
    branches = [F.when(preset == name, F.lit(system)) for name, (system, _) in jp.PRESETS.items()]
    return F.coalesce(*branches, F.lit(jp.DEFAULT_SYSTEM))


def user_prompt(preset: Column, prompt: Column, response: Column, truth: Column) -> Column:
    """Scoring prompt of a preset, filled in.

    ``name`` picks a preset with its own system prompt, ``name_plain`` the scoring prompt that
    goes with the default system prompt.
    """
    templates = {name: scoring for name, (_, scoring) in jp.PRESETS.items()}
    templates |= {f"{name}_plain": scoring for name, scoring in jp.SCORING.items()}
    filled = None
    for name, template in templates.items():
        text = _filled(template, prompt, response, truth)
        filled = F.when(preset == name, text) if filled is None else filled.when(preset == name, text)
    return filled.otherwise(_filled(jp.DEFAULT_SCORING, prompt, response, truth))


def messages(system: Column, user: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", user))


def request_body(
    provider: str, system: Column, user: Column, model: str, temperature: float = 0.0
) -> Column:
    """JSON request body in the shape of ``openai`` (and compatible), ``gemini`` or ``claude``."""
    heat = F.lit(float(temperature))

    def parts(text: Column) -> Column:
        return F.array(F.struct(text.alias("text")))

    if provider == "gemini":
        content = F.struct(F.lit("user").alias("role"), parts(user).alias("parts"))
        config = F.struct(heat.alias("temperature"), F.lit(MAX_TOKENS).alias("maxOutputTokens"))
        return F.to_json(
            F.struct(
                F.array(content).alias("contents"),
                config.alias("generationConfig"),
                F.struct(parts(system).alias("parts")).alias("systemInstruction"),
            )
        )
    if provider == "claude":
        turn = F.struct(F.lit("user").alias("role"), user.alias("content"))
        return F.to_json(
            F.struct(
                F.lit(model).alias("model"),
                F.lit(MAX_TOKENS).alias("max_tokens"),
                F.array(turn).alias("messages"),
                heat.alias("temperature"),
                system.alias("system"),
            )
        )
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            messages(system, user).alias("messages"),
            heat.alias("temperature"),
            F.lit(MAX_TOKENS).alias("max_tokens"),
        )
    )


def reply_content(provider: str, reply: Column) -> Column:
    """Text of a provider's JSON reply; empty where a gemini or claude reply holds none."""
    if provider == "gemini":
        path = "$.candidates[0].content.parts[0].text"
        return F.coalesce(F.get_json_object(reply, path), F.lit(""))
    if provider == "claude":
        return F.coalesce(F.get_json_object(reply, "$.content[0].text"), F.lit(""))
    return F.get_json_object(reply, "$.choices[0].message.content")


def first_object(content: Column) -> Column:
    """First flat ``{...}`` of a judge's text if it is JSON, else NULL."""
    found = F.nullif(F.regexp_extract(content, r"\{[^}]+\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def object_score(found: Column) -> Column:
    """The object's score as a VARIANT: 5 if it has none, NULL without an object."""
    has = F.array_contains(F.json_object_keys(found), "score")
    score = F.try_variant_get(F.try_parse_json(found), "$.score", "variant")
    return F.when(has, score).when(found.isNotNull(), F.lit(5).cast("variant"))


def free_number(content: Column) -> Column:
    """First free-standing number of a text."""
    return t.to_float(F.regexp_extract(content, r"(?U)\b(\p{Nd}+(?:\.\p{Nd}+)?)\b", 1))


def score_of(found: Column, value: Column, kind: Column, free: Column) -> Column:
    """Score in 0.1..1 from the parts of a judge's text, 0.5 where they say nothing usable.

    A score in an object is clamped to 1..10. Without an object, or with a text for a score that
    is no number, a free-standing number counts if it lies in 1..10.
    """
    number = (
        F.when(kind == "STRING", t.to_float(t.strip(F.try_variant_get(value, "$", "string"))))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )
    clamped = F.when(F.isnan(number), number).when(
        number.isNotNull(), F.least(F.greatest(number, F.lit(1.0)), F.lit(10.0)) / F.lit(10.0)
    )
    unusable = (kind == "VOID") | kind.startswith("ARRAY") | kind.startswith("OBJECT")
    fallback = F.when(free.between(1, 10), free / F.lit(10.0)).otherwise(F.lit(DEFAULT_SCORE))
    return (
        F.when(found.isNull(), fallback)
        .when(unusable, F.lit(DEFAULT_SCORE))
        .otherwise(F.coalesce(clamped, fallback))
    )


def normalize_score(
    score: Column,
    method: str = "linear",
    bias: float = 0.0,
    scale: float = 1.0,
    default: float = DEFAULT_SCORE,
) -> Column:
    """``score * scale + bias``, cut to 0..1 (``linear``) or through the logistic function
    (``sigmoid``); a NULL score becomes the default first."""
    moved = F.coalesce(score, F.lit(float(default))) * F.lit(float(scale)) + F.lit(float(bias))
    if method == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-moved))
    if method == "linear":
        return F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))
    raise ValueError(f"unknown method {method!r}")
