"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host (native).

Labelled page outcomes (good or bad) are counted per host. A host's rate of good pages has a beta prior centred on
the posterior mean of its registered domain, which has one centred on its suffix, which has one centred on the whole
table. The strength of each level's prior is estimated from the overdispersion of its counts (moments of the
beta-binomial). A page is blocked if the upper posterior bound of its host's rate is under `threshold`.

Cases: a null url or one without `://` has an empty host and path, fits no rule and shares the reputation of the empty
host; pages without an outcome count in no rate; several outcomes of one page count as bad if any is bad; with no
outcome at all every host has the neutral prior (rate 1) and is allowed; repeated pages are judged each and count each in
their host's rate; urls may have any length; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Suffixes of two labels under which names are registered.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "org.uk")
#: Levels from the host upwards.
LEVELS = ("host", "domain", "suffix")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    head = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(head), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits. rules: (host, path prefix, verdict)."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, said).otherwise(verdict)
    return name, verdict


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port."""
    labels = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    double = tail(2).isin(*SUFFIXES)
    return F.when(double, tail(3)).otherwise(tail(2)), F.when(double, tail(2)).otherwise(tail(1))


def _strength(groups: DataFrame, rate: Column) -> float:
    """Prior strength of a level from its counts n, k and the expected rate of each group."""
    n, k, var = F.col("n"), F.col("k"), rate * (1 - rate)
    x = groups.agg(F.sum((k - n * rate) ** 2 - n * var).alias("over"), F.sum(n * (n - 1) * var).alias("most")).first()
    rho = x["over"] / x["most"] if x["most"] else 0.5
    return 1 / min(max(rho, 0.001), 0.999) - 1


def host_reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """hosts: host, domain, suffix, n outcomes, k good ones. Adds rate (posterior mean) and upper (its bound)."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    whole = F.lit((total["k"] + 1) / (total["n"] + 1) if total["n"] else 1.0)
    out, parent = None, None
    for level in reversed(LEVELS):
        keys = [x for x in LEVELS[LEVELS.index(level) :]]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        groups = groups.withColumn("prior", whole) if parent is None else groups.join(parent, keys[1:])
        m = _strength(groups, F.col("prior"))
        a, n = F.col("k") + m * F.col("prior"), F.col("n") + m
        out = groups.withColumn("rate", a / n).withColumn("upper", F.col("rate") + z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + 1)))
        parent = out.select(*keys, F.col("rate").alias("prior"))
    return out.select("host", "n", "k", "rate", "upper")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages: page_id, url. outcomes: page_id, good (boolean). rules: at most a few hundred (host, path, verdict).

    Returns page_id, host, path, rule, verdict, rate, upper.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    said = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    domain, suffix = registered(F.col("host"))
    hosts = (
        parsed.join(said, "page_id", "left")
        .groupBy("host").agg(F.count("good").alias("n"), F.count(F.when(F.col("good"), 1)).alias("k"))
        .withColumn("domain", domain).withColumn("suffix", suffix)
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return parsed.join(host_reputation(hosts, z), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "rate", "upper"
    )
