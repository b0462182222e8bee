"""Judge scoring over tables: requests, calls through an injected client, score cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from rubrica.functions import judge
from rubrica.session import once
from rubrica.sources.scores import ScoreCache

_REQUEST = ("preset", "prompt", "response", "ground_truth")


def with_request(df: DataFrame, provider: str = "openai", model: str = "judge") -> DataFrame:
    """Add ``system``, ``user`` and the provider's JSON ``body``.

    Reads preset, prompt, response, ground_truth.
    """
    preset, *rest = (F.col(c) for c in _REQUEST)
    df = once(df, system=judge.system_prompt(preset), user=judge.user_prompt(preset, *rest))
    return df.withColumn("body", judge.request_body(provider, F.col("system"), F.col("user"), model))


def request_key(
    df: DataFrame, out: str = "request_key", provider: str = "openai", model: str = "judge"
) -> DataFrame:
    """Key of a request: a digest of the judge asked and of everything it gets to see."""
    return df.withColumn(out, _key(provider, model))


def _key(provider: str, model: str) -> Column:
    fields = [F.lit(provider), F.lit(model), *[F.coalesce(F.col(c), F.lit("")) for c in _REQUEST]]
    sized = [F.concat(F.length(f).cast("string"), F.lit(":"), f) for f in fields]
    return F.sha2(F.concat(*sized), 256)


def call_judge(
    df: DataFrame,
    client: Callable[[str], str],
    out: str = "reply",
    tries: int = 3,
    pause: float = 1.0,
    workers: int = 8,
) -> DataFrame:
    """Send each ``body`` through ``client`` next to the data; NULL after the last failed try.

    Calls of a batch run in ``workers`` threads; tries wait ``pause`` seconds, doubling. The
    function is marked nondeterministic so that Spark never calls it twice for one row.
    """

    def ask(body: str) -> str | None:
        for attempt in range(tries):
            try:
                return client(body)
            except Exception:
                if attempt + 1 < tries:
                    time.sleep(pause * 2**attempt)
        return None

    @F.pandas_udf(StringType())
    def ask_all(bodies: pd.Series) -> pd.Series:
        with ThreadPoolExecutor(workers) as pool:
            return pd.Series(list(pool.map(ask, bodies)), dtype="object")

    return df.withColumn(out, ask_all.asNondeterministic()("body"))


def parse_scores(df: DataFrame, content: str = "content", out: str = "score") -> DataFrame:
    """Score of each judge text; every reply is parsed once."""
    df = once(df, _found=judge.first_object(F.col(content)))
    df = once(df, _value=judge.object_score(F.col("_found")))
    df = once(df, _kind=F.schema_of_variant("_value"), _free=judge.free_number(F.col(content)))
    score = judge.score_of(F.col("_found"), F.col("_value"), F.col("_kind"), F.col("_free"))
    return once(df, **{out: score}).drop("_found", "_value", "_kind", "_free")


def judged(
    df: DataFrame,
    provider: str = "openai",
    reply: str = "reply",
    out: str = "score",
    method: str | None = None,
    **normalisation: float,
) -> DataFrame:
    """Score of each reply, 0.5 where there is none.

    With a ``method`` the score is normalised (``judge.normalize_score``: bias, scale, default), and the
    default stands in where no reply came.
    """
    content = judge.reply_content(provider, F.col(reply))
    scored = parse_scores(df.withColumn("_content", content), "_content", out).drop("_content")
    if method is None:
        return scored
    answered = F.when(F.col(reply).isNotNull(), F.col(out))
    return scored.withColumn(out, judge.normalize_score(answered, method, **normalisation))


def fresh(cache: DataFrame, now: float | None = None, ttl: float = 3600.0) -> DataFrame:
    """Latest score per request key that is not older than ``ttl`` seconds."""
    now = time.time() if now is None else now
    recent = cache.where(F.col("scored_at") >= F.lit(now - ttl))
    return recent.groupBy("request_key").agg(F.max_by("score", "scored_at").alias("cached_score"))


def unscored(
    requests: DataFrame, cached: DataFrame, provider: str = "openai", model: str = "judge"
) -> DataFrame:
    """One row per request the cache cannot answer; copies of a request are asked once."""
    keyed = _keyed(requests, provider, model)
    distinct = keyed.select("request_key", *_REQUEST).dropDuplicates(["request_key"])
    return distinct.join(cached, "request_key", "left_anti")


def with_cached(
    requests: DataFrame, cached: DataFrame, provider: str = "openai", model: str = "judge"
) -> DataFrame:
    """Requests with their cached score, NULL where there is none."""
    return _keyed(requests, provider, model).join(cached, "request_key", "left")


def score_with_cache(
    requests: DataFrame,
    cache: ScoreCache,
    client: Callable[[str], str],
    provider: str = "openai",
    model: str = "judge",
    ttl: float = 3600.0,
    now: float | None = None,
    **calls: float,
) -> DataFrame:
    """Requests with their ``score``; the judge is asked only what the cache cannot answer, and its answers are kept.

    Copies of a request are asked once. Where no reply came the score is 0.5, and the request is asked
    again next time. ``calls`` goes to ``call_judge``.
    """
    now = time.time() if now is None else now
    if "request_key" in requests.columns:
        key, wanted = F.col("request_key"), cache.deal(requests, F.col("request_key"))
        fields = ["request_key", *_REQUEST]
    else:
        key, fields = _key(provider, model), list(_REQUEST)
        digest = F.lower(F.hex("_digest"))  # half as long as the key's text
        wanted = cache.deal(requests.withColumn("_digest", F.unhex(key)), digest).drop("_digest")
    texts = requests.select(*[F.col(c).cast("string") for c in fields])
    keyed = cache.deal(_fewer(texts), key)
    asked = unscored(keyed, cache.fresh(now, ttl), provider, model)
    answered = call_judge(with_request(asked, provider, model), client, **calls).where("reply IS NOT NULL")
    scored = judged(answered, provider).select("request_key", "score", F.lit(float(now)).alias("scored_at"))
    cache.append(scored, dealt=True)  # the one action that asks; what follows reads the cache
    known = wanted.join(cache.fresh(now, ttl), "request_key", "left")
    return known.withColumn("score", F.coalesce("cached_score", F.lit(0.5))).drop("cached_score")


def _fewer(df: DataFrame) -> DataFrame:
    """Without copies within a batch of rows, so that the many copies of one request do not all go to its task."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).to_batches()

    return df.mapInArrow(distinct, df.schema)


def _keyed(requests: DataFrame, provider: str, model: str) -> DataFrame:
    if "request_key" in requests.columns:
        return requests
    return request_key(requests, provider=provider, model=model)
