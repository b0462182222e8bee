"""Dataset preparation, validation, splitting, chat and evaluation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.functions import display
from rubrica.operators import evaluation, prep, scoring
from rubrica.plans import sqltext as q
from rubrica.plans.inputs import cte, read, table
from rubrica.session import spread

_RAW = {
    "instruction": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source || ' ' || lang END",
    "input": "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE NULL END",
    "output": "text",
}
_ASK = "coalesce(instruction, '')"


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def sft_records(spark: SparkSession, sf: str) -> DataFrame:
    return prep.prepare_sft(read(spark, sf, "documents").selectExpr(*_exprs(_RAW)))


_SFT = f"""SELECT CASE WHEN input <> '' THEN {_ASK} || chr(10) || chr(10) || '输入: ' || input ELSE {_ASK} END AS prompt,
 output AS response FROM (SELECT {_sql(_RAW)} FROM documents)"""

#: JSON lines of orders with a missing key, an explicit null, a non-object, an empty object.
_LINES = {
    "row_id": "o_orderkey",
    "value": """CASE o_orderkey % 6
 WHEN 0 THEN '{"prompt": "q' || CAST(o_orderkey AS STRING) || '", "ground_truth": "' || o_orderstatus || '"}'
 WHEN 1 THEN '{"prompt": "q' || CAST(o_orderkey AS STRING) || '"}'
 WHEN 2 THEN '{"prompt": null, "ground_truth": "x"}'
 WHEN 3 THEN '[1, 2]'
 WHEN 4 THEN '{}'
 ELSE '{"ground_truth": "y", "prompt": "p"}' END""",
}


def rl_records(spark: SparkSession, sf: str) -> DataFrame:
    """RL records from raw lines: a missing key gives "", an explicit null stays NULL."""
    lines = read(spark, sf, "orders").selectExpr(*_exprs(_LINES))
    return prep.prepare_rl(lines, data_source="custom", raw="value")


_KEY = "CASE WHEN coalesce(list_contains(json_keys(value), '{k}'), false) THEN json_extract_string(value, '$.{k}') ELSE '' END"
_RL = f"""SELECT {_KEY.format(k='prompt')} AS prompt, {_KEY.format(k='ground_truth')} AS ground_truth,
 'custom' AS data_source FROM (SELECT {_sql(_LINES)} FROM orders)"""


def dpo_records(spark: SparkSession, sf: str) -> DataFrame:
    """Best against worst response per prompt, as a preference table."""
    scored = scoring.score(table(spark, sf, "rollouts"), "grpo")
    rank = F.struct("score", -F.col("response_id"))
    ends = scored.groupBy("group_id").agg(
        F.max_by("response", rank).alias("win"), F.min_by("response", rank).alias("lose")
    )
    raw = ends.select(F.concat(F.lit("order "), F.col("group_id").cast("string")).alias("q"), "win", "lose")
    return prep.prepare_dpo(raw, "q", "win", "lose")


_DPO = f"""{cte('rollouts')}, scored AS (SELECT *, {q.grpo()} AS score FROM rollouts), r AS (SELECT *,
 row_number() OVER (PARTITION BY group_id ORDER BY score DESC, response_id) AS a,
 row_number() OVER (PARTITION BY group_id ORDER BY score, response_id DESC) AS b FROM scored)
SELECT 'order ' || CAST(group_id AS STRING) AS prompt, max(CASE WHEN a = 1 THEN response END) AS chosen,
 max(CASE WHEN b = 1 THEN response END) AS rejected FROM r GROUP BY group_id"""


def sft_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation arrays, shown as text."""
    rows = prep.conversations(read(spark, sf, "conversations"))
    shown = F.transform("conversations", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return rows.select(
        "conv_id",
        F.size("conversations").cast("bigint").alias("turns"),
        F.array_join(shown, "\n").alias("dialogue"),
    )


_CHAT = """SELECT conv_id, count(*) AS turns,
 string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY ALL"""

def context_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with the four turns before them, shown as text."""
    rows = prep.context_replies(read(spark, sf, "conversations"), context_turns=4)
    shown = F.transform("context", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return rows.select("conv_id", "turn", F.array_join(shown, "\n").alias("context"), "reply")


_REPLIES = """SELECT conv_id, turn, coalesce(context, '') AS context, text AS reply FROM (SELECT *,
 string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS context
 FROM conversations) WHERE role = 'assistant'"""


def token_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut to twenty words, white space between them as it was."""
    first, last = prep.cut_tokens(20, "right"), prep.cut_tokens(20, "left")
    return read(spark, sf, "documents").select("doc_id", first(F.col("text")).alias("start"), last(F.col("text")).alias("ending"))


_CUTS = r"""SELECT doc_id, CASE WHEN n <= 20 THEN text ELSE regexp_extract(text, '^\s*\S+(\s+\S+){19}') END AS start,
 CASE WHEN n <= 20 THEN text ELSE regexp_extract(text, '(\S+\s+){19}\S+\s*$') END AS ending
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n FROM documents)"""

_SYSTEM = "CASE conv_id % 3 WHEN 0 THEN 'You are helpful.' WHEN 1 THEN '' ELSE NULL END"


def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations")
    turns = turns.withColumn("system", F.expr(_SYSTEM))
    shown = [
        display.chat_prompt(F.col("text"), F.col("system"), name).alias(name)
        for name in ("chatml", "llama", "default")
    ]
    return turns.select("conv_id", "turn", *shown)


_PROMPTS = f"""SELECT conv_id, turn,
 CASE WHEN sys <> '' THEN '<|im_start|>system' || chr(10) || sys || '<|im_end|>' || chr(10) ELSE '' END
  || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chatml,
 '<s>[INST] ' || CASE WHEN sys <> '' THEN '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10)
  ELSE '' END || text || ' [/INST]' AS llama,
 CASE WHEN sys <> '' THEN sys || chr(10) || chr(10) ELSE '' END || '用户: ' || text || chr(10) || chr(10)
  || '助手: ' AS "default"
FROM (SELECT *, {_SYSTEM} AS sys FROM conversations)"""


def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "orders").selectExpr(*_exprs(_LINES))
    bad = prep.violations(lines, ["prompt", "ground_truth"])
    return bad.select("row_id", F.concat_ws(",", "missing").alias("missing"))


def validation(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "orders").selectExpr(*_exprs(_LINES))
    out = prep.validate(lines, ["prompt", "ground_truth"])
    return out.withColumn("missing", F.concat_ws(",", "missing"))


_VIOLATIONS = f"""SELECT row_id, array_to_string(list_filter(['prompt', 'ground_truth'],
  lambda k: NOT list_contains(coalesce(json_keys(value), []), k)), ',') AS missing
FROM (SELECT {_sql(_LINES)} FROM orders) WHERE missing <> ''"""
_VALIDATION = f"""SELECT count(v.row_id) = 0 AS valid, (SELECT count(*) FROM orders) AS rows, count(v.row_id) AS bad,
 min(v.row_id) AS first_bad, arg_min(missing, row_id) AS missing FROM ({_VIOLATIONS}) v"""


def kept_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read(spark, sf, "documents"))
    return prep.drop_overlong(docs, 512, ["text"]).select("doc_id", "lang")


_KEPT = f"SELECT doc_id, lang FROM documents WHERE len({q.words('text')}) <= 512"


def truncated(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id",
        prep.truncate(text, 100, "right").alias("start"),
        prep.truncate(text, 100, "left").alias("ending"),
        prep.truncate(text, 10_000_000, "error").alias("checked"),
        prep.truncate_tokens(text, 20, "right").alias("first_words"),
        prep.truncate_tokens(text, 20, "left").alias("last_words"),
    )


_TRUNCATED = f"""SELECT doc_id, left(text, 100) AS start, right(text, 100) AS ending, text AS checked,
 array_to_string(w[1:20], ' ') AS first_words, array_to_string(w[-20:], ' ') AS last_words
FROM (SELECT *, {q.words('text')} AS w FROM documents)"""


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = prep.split_train_val(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.1)
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders")
    )


_SIZES = """SELECT split, n, n AS orders FROM (
 SELECT 'train' AS split, CAST(floor(count(*) * 9e-1) AS BIGINT) AS n FROM orders
 UNION ALL SELECT 'val', count(*) - CAST(floor(count(*) * 9e-1) AS BIGINT) FROM orders)"""


def split_ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prep.split_train_val(rows, ["o_orderkey"], 0.25, shuffle=False)


_ORDERED = """SELECT o_orderkey, o_orderpriority, CASE WHEN row_number() OVER (ORDER BY o_orderkey)
 <= floor(count(*) OVER () * 75e-2) THEN 'train' ELSE 'val' END AS split FROM orders"""

_COUNTED = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        read(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n")
        for name in _COUNTED
    ]
    return reduce(DataFrame.unionByName, parts)


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n FROM {n}" for n in _COUNTED)


def eval_results(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as prompts, conversation turns as responses, paired by position."""
    items = read(spark, sf, "documents").selectExpr(
        "doc_id", "text AS prompt", "lang AS ground_truth", "source AS data_source", "n_chars"
    )
    turns = read(spark, sf, "conversations").selectExpr("conv_id", "turn", "text AS response")
    order = [F.col("conv_id"), F.col("turn")]
    out = evaluation.assemble(items, turns, [F.col("doc_id")], order, hidden=["doc_id"])
    return evaluation.generation_prompts(out, system="Answer.", template="llama")


_EVAL = """SELECT i.pos AS id, i.text AS prompt, r.text AS response, i.lang AS ground_truth,
 i.source AS data_source, i.n_chars,
 '<s>[INST] <<SYS>>' || chr(10) || 'Answer.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || i.text
  || ' [/INST]' AS formatted
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM documents) i
JOIN (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations) r ON i.pos = r.pos"""

QUERIES = {
    "sft_records": sft_records,
    "rl_records": rl_records,
    "dpo_records": dpo_records,
    "sft_chat": sft_chat,
    "context_replies": context_replies,
    "token_cuts": token_cuts,
    "chat_prompts": chat_prompts,
    "key_violations": key_violations,
    "validation": validation,
    "overlong_filter": kept_documents,
    "truncation": truncated,
    "split_sizes": split_sizes,
    "split_ordered": split_ordered,
    "row_counts": row_counts,
    "eval_results": eval_results,
}

SQL = {
    "sft_records": _SFT,
    "rl_records": _RL,
    "dpo_records": _DPO,
    "sft_chat": _CHAT,
    "context_replies": _REPLIES,
    "token_cuts": _CUTS,
    "chat_prompts": _PROMPTS,
    "key_violations": _VIOLATIONS,
    "validation": _VALIDATION,
    "overlong_filter": _KEPT,
    "truncation": _TRUNCATED,
    "split_sizes": _SIZES,
    "split_ordered": _ORDERED,
    "row_counts": _COUNTS,
    "eval_results": _EVAL,
}
