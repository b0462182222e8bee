"""URL filter: listed rules, and empirical-Bayes reputations of hosts for every other page.

Labelled outcomes of pages (good or not) are counted per host, registered domain and suffix. A few
labelled pages say little about a host, so its share of good pages is shrunk: the suffix's towards
the overall share, the domain's towards the suffix's posterior mean, the host's towards the
domain's. How strongly is estimated per level by the method of moments of the beta-binomial: the
less the children of one parent differ beyond chance, the larger the prior's weight. A page is
blocked where the upper bound of its host's posterior lies below ``MIN_GOOD``: only hosts known
to be bad with confidence go.

Only built-in functions. Outcomes are counted before any shuffle; a host with a third of the pages
meets one row of the host table, where the adaptive skew join splits its pages. The driver sees
one overall share and three weights.

A NULL URL or one without ``://`` has an empty host and path, and gets the verdict of the empty
host. Repeated pages count once per row, an empty table gives no rows, without outcomes every host
has the neutral prior. Extra columns of either table are ignored whatever their names, and
``filter_pages`` keeps those of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.llm.common import ascii_lower, read

#: (verdict, host, path): fits the host and its subdomains where the path starts alike.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Most rules, as they become one expression.
MAX_RULES = 1000
#: Public suffixes of two labels; every other suffix is the last label.
SUFFIXES = ["ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk"]
#: A host is blocked where mean + Z standard deviations of its posterior is below MIN_GOOD.
MIN_GOOD, Z = 0.5, 1.645
#: Neutral prior mean without any outcome, and bounds of a prior's weight in pages.
NEUTRAL, LEAST_WEIGHT, MOST_WEIGHT = 0.5, 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix, without user and port; a number address and a single
    label are their own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"(:[0-9]*)?\.?$", "")
    parts = F.split(name, r"\.")
    n = F.size(parts)
    last_two = F.concat_ws(".", F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    long_suffix = last_two.isin(SUFFIXES) & (n > 2)
    last_three = F.concat_ws(".", F.slice(parts, F.greatest(n - 2, F.lit(1)), F.lit(3)))
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    domain = F.when(number | (n < 2), name).when(long_suffix, last_three).otherwise(last_two)
    last = F.get(parts, n - 1)
    suffix = F.when(number | (n < 2), name).when(long_suffix, last_two).otherwise(last)
    return domain, suffix


def matching_rule(
    host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES
) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    text = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _weight(children: DataFrame, parent: str) -> float:
    """Weight of the prior, in pages, from how much children of one parent differ beyond chance."""
    share = F.col("good") / F.col("n")
    seen = children.where(F.col("n") > 0)
    per = seen.groupBy(parent).agg(
        F.sum("n").alias("n"),
        F.sum("good").alias("good"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * share * share).alias("npp"),
        F.count(F.lit(1)).alias("k"),
    )
    mean = F.col("good") / F.col("n")
    spread = (F.col("npp") - F.col("n") * mean * mean) / (mean * (1 - mean)) - (F.col("k") - 1)
    scale = F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    row = (
        per.where((F.col("k") > 1) & (F.col("good") > 0) & (F.col("good") < F.col("n")))
        .agg(F.sum(spread).alias("a"), F.sum(scale).alias("b"))
        .first()
    )
    if not row["b"] or row["b"] <= 0:
        return LEAST_WEIGHT
    rho = row["a"] / row["b"]
    if rho <= 1 / (MOST_WEIGHT + 1):
        return MOST_WEIGHT
    return max(LEAST_WEIGHT, 1 / rho - 1)


def host_reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, good, mean, low, high) of every host in ``outcomes`` (host, good: 1, 0, or NULL
    where the page has no label)."""
    counted = outcomes.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("bigint")), F.lit(0)).alias("good")
    )
    domain, suffix = domain_of(F.col("host"))
    hosts = counted.select("host", "n", "good", domain.alias("domain"), suffix.alias("suffix"))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    overall = total["good"] / total["n"] if total["n"] else NEUTRAL
    w_suffix = _weight(suffixes.withColumn("_all", F.lit(0)), "_all")
    w_domain = _weight(domains, "suffix")
    w_host = _weight(hosts, "domain")

    def mean(prior: Column, weight: float) -> Column:
        return (F.lit(weight) * prior + F.col("good")) / (F.lit(weight) + F.col("n"))

    suffix_means = suffixes.select(F.col("suffix").alias("_s"), mean(F.lit(overall), w_suffix).alias("_sm"))
    domain_means = domains.join(suffix_means, F.col("suffix") == F.col("_s")).select(
        F.col("domain").alias("_d"), F.col("suffix").alias("_ds"), mean(F.col("_sm"), w_domain).alias("_dm")
    )
    df = hosts.join(domain_means, (F.col("domain") == F.col("_d")) & (F.col("suffix") == F.col("_ds")))
    weight = F.lit(w_host) + F.col("n")
    df = df.select("host", "n", "good", weight.alias("_w"), mean(F.col("_dm"), w_host).alias("mean"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_w") + 1))
    return df.select(
        "host", "n", "good", "mean", (F.col("mean") - Z * sd).alias("low"), (F.col("mean") + Z * sd).alias("high")
    )


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", min_good: float = MIN_GOOD) -> DataFrame:
    """Add ``_host``, ``_path``, ``_rule``, ``_verdict``, ``_mean``, ``_n`` to the pages."""
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"_host": host, "_path": path})
    known = host_reputations(outcomes).select(
        F.col("host").alias("_known"), F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("high").alias("_high")
    )
    rows = rows.join(known, F.col("_host") == F.col("_known"), "left")
    rule, verdict = matching_rule(F.col("_host"), F.col("_path"))
    by_host = F.when(F.col("_high") < min_good, "block").otherwise("allow")
    return rows.withColumns({"_rule": rule, "_verdict": F.coalesce(verdict, by_host)}).drop("_known", "_high")


def filter_pages(pages: DataFrame, outcomes: DataFrame, url: str = "url") -> DataFrame:
    """The allowed pages, with all their columns."""
    rows = pages.select(F.struct("*").alias("_row"), F.col(url).alias("_url"))
    return judge(rows, outcomes, "_url").where(F.col("_verdict") == "allow").select("_row.*")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of every page. A page shows the document whose number ends its path; the page is
    good where that document is labelled of good quality and not toxic, NULL without a label."""
    host, path = host_and_path(F.col("url"))
    shown = F.expr("try_cast(_number AS bigint)")
    rows = pages.select(host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(\.html|/)?$", 1).alias("_number"))
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    marks = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("_doc"), good.alias("good"))
    return rows.select("host", shown.alias("_shown")).join(marks, F.col("_shown") == F.col("_doc"), "left").select("host", "good")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, labelled_outcomes(pages, read(spark, sf_dir, "labels")))
    return judged.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_labelled"),
        F.round("_mean", 6).alias("reputation"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), marks AS (
  SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM labels
  WHERE quality IS NOT NULL AND toxic IS NOT NULL
), outcomes AS (
  SELECT host, m.good FROM split LEFT JOIN marks m
  ON m.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(\.html|/)?$', 1) AS BIGINT)
), named AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good,
    regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:[0-9]*)?\.?$', '') AS name
  FROM outcomes GROUP BY host
), hosts AS (
  SELECT host, n, good,
    CASE WHEN whole THEN name WHEN long THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
    CASE WHEN whole THEN name WHEN long THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
  FROM (
    SELECT *, len(p) < 2 OR regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$') AS whole,
      len(p) > 2 AND array_to_string(p[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') AS long
    FROM (SELECT *, string_split(name, '.') AS p FROM named)
  )
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL
), children AS (
  SELECT 'host' AS level, domain AS parent, n, good FROM hosts
  UNION ALL SELECT 'domain', suffix, n, good FROM domains
  UNION ALL SELECT 'suffix', '', n, good FROM suffixes
), families AS (
  SELECT level, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, sum(n * n)::DOUBLE AS nn,
    sum(good::DOUBLE * good / n) AS npp, count(*) AS k, sum(good)::DOUBLE / sum(n) AS m
  FROM children WHERE n > 0 GROUP BY level, parent
), moments AS (
  SELECT level, sum((npp - n * m * m) / (m * (1 - m)) - (k - 1)) AS a, sum(n - nn / n - (k - 1)) AS b
  FROM families WHERE k > 1 AND good > 0 AND good < n GROUP BY level
), weights AS (
  SELECT l.level, CASE WHEN b IS NULL OR b <= 0 THEN 1e0 WHEN a / b <= 1e0 / 1001 THEN 1000e0
    ELSE greatest(1e0, b / a - 1) END AS w
  FROM (VALUES ('host'), ('domain'), ('suffix')) l(level) LEFT JOIN moments USING (level)
), suffix_means AS (
  SELECT suffix, (w * coalesce((SELECT sum(good)::DOUBLE / nullif(sum(n), 0) FROM suffixes), 0.5) + good) / (w + n) AS m
  FROM suffixes, weights WHERE level = 'suffix'
), domain_means AS (
  SELECT d.suffix, d.domain, (w * s.m + d.good) / (w + d.n) AS m
  FROM domains d JOIN suffix_means s USING (suffix), weights WHERE level = 'domain'
), host_means AS (
  SELECT host, h.n, (w * d.m + good) / (w + n) AS m, w + n AS total
  FROM hosts h JOIN domain_means d ON h.domain = d.domain AND h.suffix = d.suffix, weights WHERE level = 'host'
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN m + 1.645 * sqrt(m * (1 - m) / (total + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  n::BIGINT AS n_labelled, round(m, 6) AS reputation
FROM ruled JOIN host_means USING (host)
"""
