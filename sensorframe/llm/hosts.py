"""URL filter: fixed host rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and public suffix.  Each level is a beta-binomial model
whose prior mean is the level above and whose concentration is fitted by moments over all groups of the level:
``rho = (sum n (p - mu)^2 - sum mu (1 - mu)) / sum (n - 1) mu (1 - mu)``.  A host with few labels so falls back on its
domain, and one with none has its domain's rate.  A page is blocked where the lower posterior bound
``mean - z * deviation`` of its host's bad rate exceeds the limit.

Only DataFrame functions: pages are counted by host with map-side combine before anything is joined, so a host with a
third of all pages is one small row; the join back to the pages is an ordinary one that adaptive execution can split.

Defined results: a null url, or one without ``://``, has an empty host and path.  User names and ports stay part of
``host`` but not of the name that is judged.  Repeated labels of a page count once (bad if any is bad).  Pages with a
null or repeated ``page_id`` are judged like any other.  Without labels the prior rate is one half and nothing is
blocked by the method.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import materialize

# Public suffixes of two labels
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LIMIT, Z = 0.5, 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def host_levels(host: Column) -> tuple[Column, Column, Column]:
    """The judged name, its registered domain and its public suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"(:[0-9]*|\.)$", "")
    two = F.substring_index(name, ".", -2)
    is_address = name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    suffix = F.when(is_address, "").when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(is_address, name).when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)
    return name, domain, suffix


def _concentration(groups: DataFrame) -> float:
    """Moment fit over groups ``n``, ``k`` with prior means ``mu``; a strong prior where groups don't differ."""
    spread = F.col("mu") * (1 - F.col("mu"))
    top, bottom = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mu"), 2) - spread), F.sum((F.col("n") - 1) * spread)).first()
    rho = min(max(top / bottom, 0.001), 0.5) if bottom else 0.5
    return 1 / rho - 1


def _posterior(groups: DataFrame, strength: float) -> DataFrame:
    return groups.withColumn("rate", (F.col("k") + strength * F.col("mu")) / (F.col("n") + strength))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``name, n, k, rate, deviation`` of every host name among ``pages`` (``page_id``, ``host``).

    ``outcomes`` holds ``page_id`` and ``bad`` (0 or 1) of the labelled pages.
    """
    once = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    name, domain, suffix = host_levels(F.col("host"))
    labelled = pages.select("page_id", name.alias("name"), domain.alias("domain"), suffix.alias("suffix")).join(once, "page_id", "left")
    sums = [F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")]
    hosts = materialize(labelled.groupBy("name", "domain", "suffix").agg(*sums), "hosts")
    again = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*again), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*again), "suffixes")
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    level = suffixes.withColumn("mu", F.lit(k / n if n else 0.5))
    up = _posterior(level, _concentration(level)).select("suffix", F.col("rate").alias("mu"))
    level = materialize(domains.join(up, "suffix"), "domains")
    up = _posterior(level, _concentration(level)).select("domain", "suffix", F.col("rate").alias("mu"))
    level = materialize(hosts.join(up, ["domain", "suffix"]), "hosts")
    strength = _concentration(level)
    rate = F.col("rate")
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
    return materialize(_posterior(level, strength).select("name", "n", "k", "rate", deviation.alias("deviation")), "reputations")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate`` per row of ``pages`` (``page_id``, ``url``)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputations(parsed, outcomes)
    judged = parsed.withColumn("name", host_levels(F.col("host"))[0]).join(known, "name", "left")
    text, says = fitting_rule(F.col("host"), F.col("path"), rules)
    bound = F.col("rate") - z * F.col("deviation")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(says, F.when(bound > limit, "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("bad_rate"))


def _level_sql(name: str, groups: str) -> str:
    """Concentration of a level, and the posterior rates of its groups."""
    return f"""{name}_c AS (SELECT 1 / coalesce(least(greatest(
        sum(n * (k / n - mu) * (k / n - mu) - mu * (1 - mu)) / nullif(sum((n - 1) * mu * (1 - mu)), 0), 0.001), 0.5), 0.5) - 1 AS s
      FROM {groups} WHERE n > 0),
    {name}_r AS (SELECT g.*, (k + s * mu) / (n + s) AS rate, s FROM {groups} g, {name}_c)"""


def judge_sql() -> str:
    suffixes = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    cases = {"rule": [], "says": []}
    for says, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN "
        cases["rule"].append(f"{fits}'{rule}'")
        cases["says"].append(f"{fits}'{says}'")
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    named AS (SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:[0-9]*|[.])$', '') AS name FROM parsed),
    parts AS (SELECT *, regexp_extract(name, '([^.]*[.])?[^.]*$') AS two, regexp_full_match(name, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') AS is_address FROM named),
    levels AS (SELECT *, CASE WHEN is_address THEN '' WHEN two IN ({suffixes}) THEN two ELSE regexp_extract(name, '[^.]*$') END AS suffix,
      CASE WHEN is_address THEN name WHEN two IN ({suffixes}) THEN regexp_extract(name, '([^.]*[.])?([^.]*[.])?[^.]*$') ELSE two END AS domain FROM parts),
    outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    hosts AS (SELECT name, domain, suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM levels LEFT JOIN outcomes USING (page_id) GROUP BY ALL),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
    l1 AS (SELECT *, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.5) FROM suffixes) AS mu FROM suffixes),
    {_level_sql("s", "l1")},
    l2 AS (SELECT d.*, r.rate AS mu FROM domains d JOIN s_r r USING (suffix)),
    {_level_sql("d", "l2")},
    l3 AS (SELECT h.*, r.rate AS mu FROM hosts h JOIN d_r r USING (domain, suffix)),
    {_level_sql("h", "l3")}
    SELECT page_id, host, path, CASE {" ".join(cases["rule"])} END AS rule,
      CASE {" ".join(cases["says"])} WHEN rate - {Z} * sqrt(rate * (1 - rate) / (n + s + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
      round(rate, 6) AS bad_rate
    FROM levels LEFT JOIN h_r USING (name)"""
