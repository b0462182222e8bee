"""Texts shown to people and models: chat templates, samples, times, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def chat_prompt(prompt: Column, system: Column | None = None, template: str = "default") -> Column:
    """Prompt in a chat template: ``chatml``, ``llama``, or the default for any other name.

    The system part appears only where it is non-empty.
    """
    has = F.coalesce(system != "", F.lit(False)) if system is not None else F.lit(False)
    sys_text = F.coalesce(system, F.lit("")) if system is not None else F.lit("")
    if template == "chatml":
        head = F.concat(F.lit("<|im_start|>system\n"), sys_text, F.lit("<|im_end|>\n"))
        user = F.concat(
            F.lit("<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n")
        )
        return F.when(has, F.concat(head, user)).otherwise(user)
    if template == "llama":
        head = F.concat(F.lit("<<SYS>>\n"), sys_text, F.lit("\n<</SYS>>\n\n"))
        middle = F.when(has, F.concat(head, prompt)).otherwise(prompt)
        return F.concat(F.lit("<s>[INST] "), middle, F.lit(" [/INST]"))
    user = F.concat(F.lit("用户: "), prompt, F.lit("\n\n助手: "))
    return F.when(has, F.concat(sys_text, F.lit("\n\n"), user)).otherwise(user)


def clipped(c: Column, n: int) -> Column:
    """First ``n`` characters, with dots where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def sample_text(
    step: Column, reward: Column, prompt: Column, response: Column, ground_truth: Column
) -> Column:
    """Sample as display text; absent (NULL) fields are left out."""

    def part(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"**{label}:** "), value))

    return F.concat_ws(
        "\n\n",
        part("Step", step.cast("string")),
        part("Reward", fixed_point(reward, 4)),
        part("Prompt", clipped(prompt, 200)),
        part("Response", clipped(response, 500)),
        part("Ground Truth", ground_truth),
    )


def sample_card(number: Column, step: Column, reward: Column, prompt: Column, response: Column) -> Column:
    """Sample as a dashboard card; prompt and response are cut and always end in dots."""
    return F.concat(
        F.lit("**样本 "), number.cast("string"), F.lit("** (Step "), F.coalesce(step.cast("string"), F.lit("N/A")),
        F.lit(", Reward: "), F.coalesce(fixed_point(reward, 2), F.lit("N/A")), F.lit(")\n\n**Prompt:** "),
        F.substring(F.coalesce(prompt, F.lit("N/A")), 1, 200), F.lit("...\n\n**Response:** "),
        F.substring(F.coalesce(response, F.lit("N/A")), 1, 300), F.lit("...\n\n---\n\n"),
    )


def fixed_point(x: Column, places: int) -> Column:
    """Number with ``places`` decimals, rounded by its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal spelling instead and so lifts 0.15 to 0.2. Near
    a tie the distance to it is computed without error, from two halves of the number.
    """
    scale = F.lit(2.0 * 10**places)
    high = x.cast("float").cast("double")
    tie = F.rint(x * scale)
    off = (high * scale - tie) + (x - high) * scale
    down, up = (tie - 1) / F.lit(2.0), (tie + 1) / F.lit(2.0)
    even = F.when(F.pmod(down, F.lit(2.0)) == 0, down).otherwise(up)
    nearest = F.when(off < 0, down).when(off > 0, up).otherwise(even) / F.lit(10.0**places)
    near = (F.pmod(tie, F.lit(2.0)) == 1) & (F.abs(off) < 0.01)
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", F.when(near, nearest).otherwise(x)))


def clock(seconds: Column) -> Column:
    """HH:MM:SS; hours may exceed 24."""
    whole = F.floor(seconds).cast("bigint")
    hours = F.floor(whole / F.lit(3600)).cast("bigint")
    minutes = F.floor((whole % F.lit(3600)) / F.lit(60)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", hours, minutes, whole % F.lit(60))


def progress_text(
    step: Column, total: int, elapsed: Column, metrics: Sequence[tuple[str, Column]] = ()
) -> Column:
    """Progress line: percent done, minutes left, numeric metrics."""
    percent = step / F.lit(total) * F.lit(100.0)
    eta = F.when(step > 0, F.try_divide(elapsed, step) * (F.lit(total) - step)).otherwise(F.lit(0.0))
    shown = [
        F.concat(F.lit(f"{name}: "), fixed_point(c, 4))
        for name, c in metrics
    ]
    return F.concat(
        F.format_string(f"Step %d/{total} (", step),
        fixed_point(percent, 1),
        F.lit("%) | ETA: "),
        fixed_point(eta / F.lit(60.0), 1),
        F.lit("min | "),
        F.concat_ws(" | ", *shown) if shown else F.lit(""),
    )
