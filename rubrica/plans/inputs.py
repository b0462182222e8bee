"""Tables the registered queries share, derived from the driver tables.

Each derivation is a list of select lists, applied one after the other, in SQL that Spark and
DuckDB read alike; ``table`` builds it in Spark and ``cte`` spells it for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rubrica.session import spread, tune

_GOT = "CAST(got AS STRING)"
_NL, _BOX = "chr(10)", "chr(92) || 'boxed{'"
_G5 = "CAST(want % 5 AS STRING)"

_MATH = f"""CASE line
 WHEN 1 THEN '第1步: ' || {_GOT} || ' + 0 = ' || {_GOT} || {_NL} || '#### ' || {_GOT}
 WHEN 2 THEN '首先计算，然后得到 because = ' || {_GOT} || ' ' || {_BOX} || {_GOT} || '}}'
 WHEN 3 THEN 'Step 1. First, compute 2*3=6. Then 2. So #### 1,' || {_GOT}
 WHEN 4 THEN '我觉得是' || {_GOT} || '吧'
 WHEN 5 THEN 'The answer is ' || {_GOT} || '.0, since it is known'
 WHEN 6 THEN '答案: ' || {_GOT} || ' 元'
 ELSE '{{"answer": ' || {_GOT} || '}} ' || {_BOX} || 'x}} ' || {_BOX} || ' ' || {_GOT} || ' }}' END"""

_CODE = f"""CASE
 WHEN line IN (1, 4, 7) THEN 'def f(x: int) -> int:' || {_NL} || '    \"\"\"doc\"\"\"' || {_NL}
   || '    return x + ' || {_GOT}
 WHEN line IN (2, 5) THEN 'def f(x) return ' || {_GOT}
 WHEN line = 3 THEN 'class A:' || {_NL} || '    pass'
 ELSE 'total = ' || {_GOT} END"""

_QA = f"""CASE line
 WHEN 1 THEN 'Well, Alpha Beta  Gamma G' || {_G5} || ' omega or alpha beta gamma g' || {_G5} || ' omega'
 WHEN 2 THEN 'omega gamma beta alpha g9'
 WHEN 3 THEN 'alpha beta gamma delta'
 WHEN 4 THEN 'alpha beta x'
 WHEN 5 THEN 'alpha'
 WHEN 6 THEN 'none of these'
 ELSE 'g0 omega alpha beta gamma' END"""

_TALK = """repeat('word ', CAST(line * line AS INT))
 || CASE WHEN got % 2 = 0 THEN 'Thank you' ELSE 'ok' END
 || CASE WHEN got % 3 = 0 THEN ' dear' ELSE '' END"""

_LABEL = """CASE line % 4 WHEN 0 THEN 'I feel positive' WHEN 1 THEN 'NEGATIVE mood'
 WHEN 2 THEN '是的' ELSE 'other thing' END"""

_JSON = f"""CASE line % 5 WHEN 0 THEN '{{"a": 1}}' WHEN 1 THEN 'x {{"a": ' || {_GOT} || '}} y'
 WHEN 2 THEN 'x {{}} y' WHEN 3 THEN 'none' ELSE '[1, 2' END"""

_LINE_ID = (
    "l_linenumber * 100000000000000000 + l_partkey * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS INT)"
)

#: One row per model response: 8 kinds of task by order, 7 text shapes by line number.
_ROLLOUTS = (
    "lineitem",
    [
        {
            "group_id": "l_orderkey",
            "response_id": _LINE_ID,
            "line": "l_linenumber",
            "want": "CAST(l_orderkey % 50 + 1 AS INT)",
            "quantity": "CAST(l_quantity AS INT)",
            "step": "l_suppkey % 20",
            "kind": "l_orderkey % 8",
        },
        {
            "*": "",
            "got": "CASE WHEN line % 3 = 0 THEN want ELSE quantity END",
        },
        {
            "group_id": "group_id",
            "response_id": "response_id",
            "step": "step",
            "line": "line",
            "data_source": "CASE kind WHEN 0 THEN 'math_reasoning' WHEN 1 THEN 'gsm8k' WHEN 2 THEN 'code'"
            " WHEN 3 THEN 'qa' WHEN 4 THEN 'dialogue' WHEN 5 THEN 'classification'"
            " WHEN 6 THEN 'custom' ELSE 'json_output' END",
            "ground_truth": f"CASE kind WHEN 3 THEN 'alpha beta gamma g' || {_G5} || ' omega'"
            " WHEN 4 THEN 'Hello my dear friend over there and more words'"
            " WHEN 5 THEN CASE want % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative'"
            " WHEN 2 THEN '是' ELSE 'other' END"
            " ELSE CAST(want AS STRING) END",
            "response": f"CASE kind WHEN 2 THEN {_CODE} WHEN 3 THEN {_QA} WHEN 4 THEN {_TALK}"
            f" WHEN 5 THEN {_LABEL} WHEN 7 THEN {_JSON} ELSE {_MATH} END",
        },
    ],
)

#: One row per logged training step: a run per user, steps in time order.
_METRICS = (
    "events",
    [
        {
            "experiment": "'run_' || CAST(user_id AS STRING)",
            "seq": "event_id",
            "is_event": "event_type = 'signup'",
            "event": "event_type",
            "reward_mean": "value",
            "kl_divergence": "CAST(json_k AS DOUBLE) / 500e0",
            "gpu_utilization": "CAST(json_k AS DOUBLE)",
            "epoch": "CAST(json_k % 7 AS BIGINT)",
            "timestamp": "CAST(event_id AS DOUBLE) * 1.5e0",
        },
    ],
)

#: Token log-probabilities: a sequence per order, tokens by response key.
_TOKENS = (
    "lineitem",
    [
        {
            "seq_id": "l_orderkey",
            "token_id": _LINE_ID,
            "logp": "-l_discount - l_quantity / 100e0",
            "old_logp": "-l_tax - l_quantity / 100e0",
            "ref_logp": "-l_tax / 2e0 - l_quantity / 90e0",
            "reward": "l_discount - 5e-2",
            "value": "l_tax + l_quantity / 313e0",
            "advantage": "l_extendedprice / 50000e0 - 1e0",
        },
    ],
)

TABLES = {"rollouts": _ROLLOUTS, "metrics": _METRICS, "tokens": _TOKENS}

#: How each engine reads a number out of the events' JSON.
_JSON_K = {
    "spark": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "duckdb": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
}


def _select(columns: dict[str, str], engine: str) -> list[str]:
    out = []
    for name, expr in columns.items():
        expr = expr.replace("json_k", _JSON_K[engine])
        out.append("*" if name == "*" else f"{expr} AS {name}")
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_of(source: DataFrame, name: str) -> DataFrame:
    """Derive a table from a batch or streaming DataFrame of its driver table."""
    for stage in TABLES[name][1]:
        source = source.selectExpr(*_select(stage, "spark"))
    return source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return table_of(spread(read(spark, sf_dir, TABLES[name][0])), name)


def cte(*names: str) -> str:
    """``WITH`` clause (without further CTEs) that defines the named tables for DuckDB."""
    parts = []
    for name in names:
        source, stages = TABLES[name]
        sql = source
        for i, stage in enumerate(stages):
            sql = f"(SELECT {', '.join(_select(stage, 'duckdb'))} FROM {sql} s{i})"
        parts.append(f"{name} AS {sql}")
    return "WITH " + ",\n".join(parts)
