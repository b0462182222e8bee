"""Batch evaluation: prompts out, responses joined back by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions.display import chat_prompt
from rubrica.operators.ordering import GROUP_LIMIT, number_rows


def generation_prompts(
    items: DataFrame, prompt: str = "prompt", system: str | None = None, template: str = "chatml"
) -> DataFrame:
    """Add ``formatted``, the text a model is to continue."""
    system_col = F.lit(system) if system is not None else None
    text = F.coalesce(F.col(prompt), F.lit(""))
    return items.withColumn("formatted", chat_prompt(text, system_col, template))


def assemble(
    items: DataFrame,
    responses: DataFrame,
    item_order: Sequence[Column],
    response_order: Sequence[Column],
    prompt: str = "prompt",
    ground_truth: str = "ground_truth",
    response: str = "response",
    hidden: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(id, prompt, response, ground_truth, other item columns), paired by position from 1.

    Ends with the shorter side. A further item column named id or response takes the place of
    the computed one. ``hidden`` item columns only serve the order.
    """
    sizes = items.count(), responses.count()
    left = number_rows(items, [], item_order, "_pos", limit, bound=sizes[0])
    right = number_rows(responses, [], response_order, "_pos", limit, bound=sizes[1])
    # what finds no partner need not cross the join
    left, right = (side.where(F.col("_pos") <= min(sizes)) for side in (left, right))
    right = right.select("_pos", F.col(response).alias("_response"))
    paired = left.join(right, "_pos")
    columns = {
        "id": F.col("_pos"),
        "prompt": F.col(prompt) if prompt in items.columns else F.lit(""),
        "response": F.col("_response"),
        "ground_truth": F.col(ground_truth) if ground_truth in items.columns else F.lit(""),
    }
    for name in items.columns:
        if name not in (prompt, ground_truth, *hidden):
            columns[name] = F.col(name)
    return paired.select(*[c.alias(name) for name, c in columns.items()])
