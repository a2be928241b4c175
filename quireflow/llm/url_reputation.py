"""URL filter: fixed rules, then empirical-Bayes reputation of hosts. DataFrame functions only.

Labelled page outcomes are counted per host with partial aggregation; a beta-binomial posterior is shrunk step by step: the public suffix toward
the whole, the registered domain toward its suffix, the host toward its registered domain, by strengths that fit the spread between the sites
of a level (method of moments). Hosts without labels have their domain's posterior, else their suffix's, else the whole's. A url is blocked when
its host's posterior says with probability SURE that the bad share lies above LIMIT: that is, when the lower bound of the share is above it. So a few bad
pages cannot block a host about which little is known.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: (action, host, path). The longest fitting rule wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least and most pseudo-observations that a level lends to the level below it.
LEAST, MOST = 1.0, 10_000.0
LIMIT, SURE = 0.5, 0.95
# Public suffixes of more than one label under which anybody can register a name.
PUBLIC_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.kr", "go.kr", "or.kr", "co.in", "gov.in", "net.in", "org.in", "ac.nz", "co.nz", "govt.nz", "org.nz", "ac.za", "co.za", "org.za", "com.mx", "com.tr", "com.tw", "com.vn", "edu.vn", "gov.vn",
)
#: Steps on each side of LIMIT in which a posterior is integrated.
STEPS = 200
#: Hosts (some 60 bytes each) that may be broadcast to their pages.
BROADCAST_HOSTS = 300_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z in lower case; empty for null or no ://."""
    found = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, as host and path in one string; its action); null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # longer ones are looked at first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def strength(sites: DataFrame, above: Column) -> float:
    """Pseudo-observations that the level above lends, from the spread of the bad shares of sites (n, bad) around that of their group above; MOST where no group has two sites to compare."""
    groups = sites.where("n > 0").groupBy(above.alias("above")).agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("means"))
    noise = F.col("bad") / F.col("n") * (1 - F.col("bad") / F.col("n"))
    excess, room = groups.agg(F.sum(F.col("means") - F.col("bad") * F.col("bad") / F.col("n") - (F.col("k") - 1) * noise), F.sum((F.col("n") - F.col("squares") / F.col("n")) * noise)).first()
    return min(MOST, max(LEAST, room / excess - 1)) if room and excess > 0 else MOST


def above(mean: Column, var: Column, limit: float) -> Column:
    """Probability that a share with a beta distribution of this mean and variance lies above limit.

    Over t = log(x / (1 - x)) the density of x is smooth, x**a (1 - x)**b but for a constant, whatever a and b; it is summed by the trapezoid rule
    on both sides of the limit, out to where it has vanished.
    """
    size = F.greatest(F.lit(1e-3), mean * (1 - mean) / var - 1)
    a, b = mean * size, (1 - mean) * size
    middle, cut = F.log(a / b), math.log(limit / (1 - limit))
    wide = 30 * F.sqrt(1 / a + 1 / b + 1 / (a * a) + 1 / (b * b))
    # log(1 + e**t), which e**t alone would overflow
    rise = lambda t: F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    log_density = lambda t: -a * rise(-t) - b * rise(t)

    def side(far: Column) -> Column:
        step = (far - cut) / STEPS
        sums = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + F.when((i == 0) | (i == STEPS), 0.5).otherwise(1.0) * F.exp(log_density(cut + i * step) - log_density(middle)))
        return F.abs(step) * sums

    low, high = side(F.least(middle, F.lit(cut)) - wide), side(F.greatest(middle, F.lit(cut)) + wide)
    return high / (low + high)


def sites(host: Column, public_suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host: the suffix is the listed one that it ends with, else its last label; the domain has one label more."""
    listed = "|".join(re.escape(x) for x in sorted(public_suffixes, key=lambda x: (-x.count("."), x)))
    found = F.regexp_extract(host, rf"(?:^|\.)({listed})$", 1) if listed else F.lit("")
    suffix = F.when(found != "", found).otherwise(F.substring_index(host, ".", -1))
    labels = F.size(F.split(suffix, r"\.")) + 1
    all_ = F.split(host, r"\.")
    return F.array_join(F.slice(all_, F.greatest(F.lit(1), F.size(all_) - labels + 1), labels), "."), suffix


def reputations(outcomes: DataFrame, limit: float = LIMIT, public_suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, bad, mean, sure) from rows (host, bad 0/1/null): every host's posterior bad share, and how probable it is above limit.

    A row whose bad is null only names its host, which has n = 0 if it has no other. Mean at each level: (bad + strength * mean of the level
    above) / (n + strength); at the top (bad + 1) / (n + 2). The variance is the beta's, and that of the level above by the share that comes from there.
    """
    domain, suffix = sites(F.col("host"), public_suffixes)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = tables.written(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = (x or 0 for x in suffixes.agg(F.sum("n"), F.sum("bad")).first())
    top = (bad + 1) / (n + 2)

    def shrunk(level: DataFrame, lent: float, mean_above: Column, var_above: Column) -> DataFrame:
        mean = (F.col("bad") + lent * mean_above) / (F.col("n") + lent)
        var = mean * (1 - mean) / (F.col("n") + lent + 1) + F.pow(lent / (F.col("n") + lent), 2) * var_above
        return level.withColumns({"mean": mean, "var": var})

    upper = lambda df, key: df.select(key, F.col("mean").alias("m"), F.col("var").alias("v"))
    suffixes = shrunk(suffixes, strength(suffixes, F.lit(0)), F.lit(top), F.lit(top * (1 - top) / (n + 3)))
    domains = shrunk(domains.join(upper(suffixes, "suffix"), "suffix"), strength(domains, F.col("suffix")), F.col("m"), F.col("v")).drop("m", "v")
    out = shrunk(hosts.join(upper(domains, "domain"), "domain"), strength(hosts, F.col("domain")), F.col("m"), F.col("v"))
    return out.withColumn("sure", above(F.col("mean"), F.col("var"), limit)).select("host", "domain", "suffix", "n", "bad", "mean", "sure")


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = LIMIT, sure: float = SURE, public_suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """A row per row of pages: (page_id, host, path, rule, verdict, bad_share, bad_sure).

    outcomes has rows (page_id, bad), bad 1 for a page found bad, 0 for a good one; null outcomes and ids count for nothing. A host without
    labelled pages has the shares of its registered domain, else of its suffix, else of the whole. Null urls and urls without :// have host and path empty:
    no rule fits these, and they get no reputation. Repeated pages each get a row; each labelled row counts. Of rules that fit, the one with the
    longest host and path in all wins; of equally long ones the first. Empty tables give empty or rule-only results; extra columns are ignored.

    Hosts meet their pages by broadcast up to BROADCAST_HOSTS; beyond, by a join in which Spark splits the pages of a hot host.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.select("page_id", F.col("bad").cast("int").alias("bad")).where("page_id is not null and bad is not null")
    known = split.where("host <> ''").select("page_id", "host").join(known, "page_id", "left").select("host", "bad")
    shares = reputations(known, limit, public_suffixes).select("host", F.col("mean").alias("bad_share"), F.col("sure").alias("bad_sure"))
    shares = tables.small_or_not(tables.written(shares, "reputations"), BROADCAST_HOSTS)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("bad_sure") >= sure, "block").otherwise("allow"))
    return split.join(shares, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_share", "bad_sure")


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages, with the labels of the document of the same number as a page's outcome: bad if of low quality or toxic."""
    labels = tables.read(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(tables.read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_url_reputation": op9_url_reputation}
ORACLES = {
    "op9_url_reputation": r"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         CASE WHEN regexp_matches(host, '(^|\.)({listed})$') THEN regexp_extract(host, '(?:^|\.)({listed})$', 1) ELSE split_part(host, '.', -1) END AS suffix
  FROM (SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN (quality = 0 OR toxic = 1) IS NOT NULL THEN 0 END AS bad
        FROM split LEFT JOIN labels ON page_id = doc_id WHERE host <> '')
  GROUP BY host),
named AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - len(string_split(suffix, '.'))), len(string_split(host, '.'))), '.') AS domain FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
whole AS (SELECT (coalesce(sum(bad), 0) + 1e0) / (coalesce(sum(n), 0) + 2e0) AS m, coalesce(sum(n), 0) AS n FROM suffixes),
levels AS (
  SELECT 'suffix' AS level, '' AS above, n, bad FROM suffixes WHERE n > 0 UNION ALL SELECT 'domain', suffix, n, bad FROM domains WHERE n > 0
  UNION ALL SELECT 'host', domain, n, bad FROM named WHERE n > 0),
grouped AS (
  SELECT level, above, count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS squares, sum(bad * bad / n::DOUBLE) AS means FROM levels GROUP BY level, above),
moments AS (
  SELECT level, sum(means - bad * bad / n - (k - 1) * (bad / n * (1 - bad / n))) AS excess, sum((n - squares / n) * (bad / n * (1 - bad / n))) AS room FROM grouped GROUP BY level),
lent AS (
  SELECT kind.level, CASE WHEN room <> 0 AND excess > 0 THEN least(1e4, greatest(1e0, room / excess - 1)) ELSE 1e4 END AS s
  FROM (VALUES ('suffix'), ('domain'), ('host')) AS kind(level) LEFT JOIN moments ON moments.level = kind.level),
s1 AS (SELECT suffix, (bad + s * m) / (x.n + s) AS mean, x.n, s, m * (1 - m) / (whole.n + 3) AS v FROM suffixes x, whole, lent WHERE level = 'suffix'),
s2 AS (SELECT suffix, mean AS m, mean * (1 - mean) / (n + s + 1) + pow(s / (n + s), 2) * v AS v FROM s1),
d1 AS (SELECT domain, (bad + s * m) / (n + s) AS mean, n, s, v FROM domains JOIN s2 USING (suffix), lent WHERE level = 'domain'),
d2 AS (SELECT domain, mean AS m, mean * (1 - mean) / (n + s + 1) + pow(s / (n + s), 2) * v AS v FROM d1),
h1 AS (SELECT host, (bad + s * m) / (n + s) AS mean, n, s, v FROM named JOIN d2 USING (domain), lent WHERE level = 'host'),
h2 AS (SELECT host, mean, greatest(1e-3, mean * (1 - mean) / (mean * (1 - mean) / (n + s + 1) + pow(s / (n + s), 2) * v) - 1) AS size FROM h1),
betas AS (SELECT host, mean * size AS a, (1 - mean) * size AS b FROM h2),
spans AS (SELECT *, ln(a / b) AS mid, 30 * sqrt(1 / a + 1 / b + 1 / (a * a) + 1 / (b * b)) AS wide FROM betas),
steps AS (SELECT *, (least(mid, 0e0) - wide) / 200 AS down, (greatest(mid, 0e0) + wide) / 200 AS up, a * (greatest(-mid, 0) + ln(1 + exp(-abs(mid)))) + b * (greatest(mid, 0) + ln(1 + exp(-abs(mid)))) AS top FROM spans),
density AS (
  SELECT host, down, up, list_sum(list_transform(range(0, 201), lambda i: CASE WHEN i IN (0, 200) THEN 0.5e0 ELSE 1e0 END * exp(top - a * (greatest(-i * down, 0) + ln(1 + exp(-abs(i * down)))) - b * (greatest(i * down, 0) + ln(1 + exp(-abs(i * down))))))) AS below,
         list_sum(list_transform(range(0, 201), lambda i: CASE WHEN i IN (0, 200) THEN 0.5e0 ELSE 1e0 END * exp(top - a * (greatest(-i * up, 0) + ln(1 + exp(-abs(i * up)))) - b * (greatest(i * up, 0) + ln(1 + exp(-abs(i * up))))))) AS over FROM steps),
judged AS (SELECT host, up * over / (up * over - down * below) AS sure FROM density),
ruled AS (
  SELECT page_id, split.host, path, sure, CASE
    WHEN (split.host = 'example.net' OR split.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (split.host = 'example.com' OR split.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (split.host = 'org' OR split.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (split.host = 'net' OR split.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split LEFT JOIN judged ON split.host = judged.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN sure >= 0.95 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""".replace("{listed}", "|".join(re.escape(x) for x in PUBLIC_SUFFIXES)),
}
