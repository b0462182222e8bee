"""DuckDB spellings of the scoring rules, for the oracle side of the registered queries.

The oracle regex dialect reads bare patterns as Unicode-blind and knows no (?U); derived texts keep
digits and whitespace ASCII, so the bare patterns mean the same there.
"""

from __future__ import annotations

import re

from rubrica.functions import fixed


def bare(pattern: str) -> str:
    """Pattern without the Java-only flags, quoted as a SQL literal."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if flags:
        keep = "".join(f for f in flags.group(1) if f in "ims")
        pattern = (f"(?{keep})" if keep else "") + pattern[flags.end():]
    return lit(pattern)


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def boxed(x: str) -> str:
    return strip(f"regexp_extract_all({x}, {lit(fixed.BOXED)}, 1)[-1]")


def after(x: str, marker: str) -> str:
    return f"CASE WHEN contains({x}, {lit(marker)}) THEN string_split({x}, {lit(marker)})[-1] END"


def marked_text(x: str, marker: str) -> str:
    return strip(f"replace({strip(after(x, marker))}, ',', '')")


def marked_number(x: str, markers: list[str]) -> str:
    tails = [f"nullif(regexp_extract({after(x, m)}, {bare(fixed.NUMBER)}), '')" for m in markers]
    return f"coalesce({', '.join(tails)})"


def common_answer(x: str) -> str:
    return f"coalesce({boxed(x)}, {', '.join(marked_text(x, m) for m in fixed.COMMON_MARKERS)})"


def last_object(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(fixed.FLAT_OBJECT)}, 0)[-1]"


def plain(x: str) -> str:
    return strip(f"replace(replace({x}, ',', ''), ' ', '')")


def number(x: str) -> str:
    return f"TRY_CAST({plain(x)} AS DOUBLE)"


def same(answer: str, truth: str) -> str:
    """Normalised equality, NULL without an answer."""
    a, b = number(answer), number(f"coalesce({truth}, '')")
    ta, tb = f"lower({plain(answer)})", f"lower({plain(f'coalesce({truth}, {lit(str())})')})"
    return (
        f"CASE WHEN {answer} IS NULL THEN NULL WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} = {b}"
        f" WHEN {a} IS NULL AND {b} IS NULL THEN {ta} = {tb} ELSE false END"
    )


def any_of(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {bare(p)})" for p in patterns) + ")"


def has_any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def overlap(want: str, said: str) -> str:
    w, s = words(want), words(said)
    return (
        f"coalesce(len(list_intersect(list_distinct({w}), {s})) * 1e0"
        f" / nullif(len(list_distinct({w})), 0), 0e0)"
    )


def in_list(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in values)})"


def math(answer: str, truth: str) -> str:
    a, b = number(answer), number(truth)
    text = f"lower({strip(answer)}) = lower({strip(truth)})"
    return (
        f"CASE WHEN {answer} IS NULL THEN 0e0"
        f" WHEN (CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN abs({a} - {b}) < 1e-6 ELSE {text} END)"
        f" THEN 1e0 ELSE 0e0 END"
    )


def code(x: str) -> str:
    return f"CASE WHEN {has_any(x, ['def ', 'class '])} THEN 5e-1 ELSE 0e0 END"


def qa(x: str, truth: str) -> str:
    said, want = f"lower({strip(x)})", f"lower({strip(truth)})"
    return f"CASE WHEN contains({said}, {want}) THEN 1e0 ELSE {overlap(want, said)} END"


def json_format(x: str) -> str:
    inner = last_object(x)
    return (
        f"CASE WHEN json_valid({x}) THEN 1e0 WHEN json_valid({inner})"
        f" AND NOT regexp_full_match({inner}, '\\{{\\s*\\}}') THEN 5e-1 ELSE 0e0 END"
    )


def length_penalty(x: str, base: str, low: int, high: int) -> str:
    n = f"length({x})"
    return (
        f"greatest(0e0, {base} - CASE WHEN {n} < {low} THEN ({low}e0 - {n}) / {low}e0 * 1e-1"
        f" WHEN {n} > {high} THEN ({n} - {high}e0) / {high}e0 * 1e-1 ELSE 0e0 END)"
    )


def process(x: str) -> str:
    kinds = " + ".join(f"regexp_matches({x}, {bare(p)})::INT" for p in fixed.GRPO_STEPS)
    return (
        f"least(CASE WHEN {kinds} >= 2 THEN 2e-1 WHEN {kinds} >= 1 THEN 1e-1 ELSE 0e0 END"
        f" + CASE WHEN regexp_matches({x}, {bare(fixed.ARITHMETIC)}) THEN 1e-1 ELSE 0e0 END, 3e-1)"
    )


def quality(x: str) -> str:
    hits = " + ".join(f"len(regexp_extract_all({x}, {bare(p)}))" for p in fixed.GSPO_STEPS)
    return (
        f"least(CASE WHEN {hits} >= 4 THEN 3e-1 WHEN {hits} >= 2 THEN 2e-1 WHEN {hits} >= 1 THEN 1e-1"
        f" ELSE 0e0 END + CASE WHEN {any_of(x, fixed.GSPO_CALCULATION)} THEN 1e-1 ELSE 0e0 END"
        f" + CASE WHEN {has_any(f'lower({x})', fixed.GSPO_EXPLANATIONS)} THEN 1e-1 ELSE 0e0 END, 5e-1)"
    )


def bands(x: str, truth: str, steps: list[tuple[float, float]], low: float) -> str:
    said, want = strip(f"lower({x})"), strip(f"lower({truth})")
    tail = " ".join(f"WHEN {overlap(want, said)} > {a}::DOUBLE THEN {v}::DOUBLE" for a, v in steps)
    return f"CASE WHEN contains({said}, {want}) THEN 1e0 {tail} ELSE {low}::DOUBLE END"


#: The derived code texts parse unless their line number is 2 or 5.
PARSES = "line NOT IN (2, 5)"


def grpo(x: str = "response", truth: str = "ground_truth") -> str:
    answer = f"coalesce({boxed(x)}, {marked_number(x, fixed.GRPO_MARKERS)})"
    match = same(answer, truth)
    want = f"lower({truth})"
    src = fixed.GRPO_SOURCES
    return f"""CASE
 WHEN {in_list('data_source', src['math'])} THEN
   CASE WHEN {match} IS NULL THEN 0e0 WHEN {match} THEN 1e0 ELSE 1e-1 END
 WHEN {in_list('data_source', src['code'])} THEN CASE WHEN {PARSES} THEN 1e-1 ELSE 0e0 END
 WHEN {in_list('data_source', src['qa'])} THEN {bands(x, truth, [(0.8, 1.0), (0.5, 0.1)], 0.0)}
 WHEN {in_list('data_source', src['label'])} THEN
   CASE WHEN {in_list(want, fixed.GRPO_LABELS)} AND contains(lower({x}), {want}) THEN 1e0 ELSE 0e0 END
 WHEN {match} IS NULL THEN 0e0 WHEN {match} THEN 1e0 ELSE 0e0 END"""


def gspo(x: str = "response", truth: str = "ground_truth") -> str:
    answer = f"coalesce({boxed(x)}, {marked_number(x, fixed.GSPO_MARKERS)})"
    match, q = same(answer, truth), quality(x)
    src = fixed.GSPO_SOURCES

    def points(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE 0e0 END"

    return f"""CASE
 WHEN {in_list('data_source', src['math'])} THEN
   CASE WHEN {match} IS NULL THEN 0e0 + {q} * 5e-1 WHEN {match} THEN least(1e0 + {q}, 15e-1) ELSE 1e-1 + {q} END
 WHEN {in_list('data_source', src['code'])} THEN least(
   {points(f"regexp_matches({x}, {bare(fixed.GSPO_FUNCTION)})", '2e-1')}
   + {points(any_of(x, fixed.GSPO_DOCSTRINGS), '1e-1')}
   + {points(f"regexp_matches({x}, {bare(fixed.GSPO_RETURN_TYPE)})", '1e-1')}
   + {points(PARSES, '3e-1')}, 1e0)
 WHEN {in_list('data_source', src['qa'])} THEN {bands(x, truth, [(0.8, 1.0), (0.5, 0.5), (0.2, 0.1)], 0.0)}
 WHEN {in_list('data_source', src['dialogue'])} THEN least(
   CASE WHEN length({x}) BETWEEN 50 AND 500 THEN 3e-1 WHEN length({x}) BETWEEN 20 AND 1000 THEN 2e-1 ELSE 0e0 END
   + {points(has_any(f'lower({x})', fixed.GSPO_POLITE), '1e-1')}
   + {points(f"len(list_filter({words(f'lower({truth})')}[1:5], lambda w: contains(lower({x}), w))) > 0", '3e-1')}, 1e0)
 WHEN {match} IS NULL THEN 0e0 WHEN {match} THEN 1e0 ELSE 1e-1 END"""
