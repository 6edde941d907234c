"""URL filter: allow and block rules first, then an Empirical-Bayes reputation of the host.

Outcomes of labelled pages are shrunk through beta-binomial priors from suffix to registered domain to host: a level's prior
mean is the posterior mean of the level above, its strength is fitted to that level's counts over all groups. A page is
blocked when the lower posterior bound of its host's bad share is above a threshold. Hosts without a labelled page are judged
by the same rule: their prior comes from the nearest level above that has labels.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Public suffixes of two labels that this filter knows; all others have one.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in"]
THRESHOLD = 0.2
Z = 1.6448536269514722
LEVELS = ["suffix", "domain", "host"]


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both are empty for null or without `://`. Only A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. A rule fits its host and all subdomains if the path starts with its path."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rule_path))
        name = F.when(fits, F.lit(rule)).otherwise(F.lit(None).cast("string") if name is None else name)
        verdict = F.when(fits, F.lit(kind)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return name, verdict


def with_levels(rows: DataFrame) -> DataFrame:
    """Adds suffix and domain to rows with host; a port is not part of either. An empty host is its own suffix and domain."""
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    last_two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    long = last_two.isin(LONG_SUFFIXES)
    last = F.element_at(labels, -1)
    last_three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return rows.withColumn("suffix", F.when(long, last_two).otherwise(last)).withColumn("domain", F.when(long, last_three).otherwise(last_two))


def reputations(outcomes: DataFrame, z: float = Z, hosts: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, mean, bound) from rows (host, bad 0/1); host has its whole name, n counts the labelled pages.

    Rows (host) of `hosts` are answered too, with n = bad = 0 where they have no outcome: with nothing counted, the posterior of
    a host, domain or suffix is its prior Beta(s m, s (1-m)), so the mean of the nearest level with labels comes down unchanged.
    Below a level that has no labels either, the spreads of both add up: 1/(s+1) is 1 minus the product of the levels' s/(s+1),
    which is the exact variance of the chain. The fit of the strengths leaves them out.

    Every level: groups are counted, each gets its parent's posterior mean m as prior mean, and one strength s for the level is
    fitted by moments to all groups with at least two pages: with p = bad/n, E[(p - m)^2] = m(1-m)/n * (1 + (n-1)/(s+1)). The
    posterior is Beta(s m + bad, s (1-m) + n - bad), its lower bound is mean - z * standard deviation, not below 0.
    """
    seen = outcomes.select("host", F.lit(1).alias("n"), "bad")
    if hosts is not None:
        seen = seen.unionByName(hosts.select("host", F.lit(0).alias("n"), F.lit(0).alias("bad")))
    counts = with_levels(seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    above = total.select(F.lit(1).alias("_all"), ((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("prior"), F.lit(0.0).alias("open"))
    parent = "_all"
    for level in LEVELS:
        keys = LEVELS[: LEVELS.index(level) + 1]
        here = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("_all", F.lit(1))
        on = ["_all"] if parent == "_all" else LEVELS[: LEVELS.index(level)]
        here = here.join(above, on)
        p, m, n = F.col("bad") / F.col("n"), F.col("prior"), F.col("n")
        wide = m * (1 - m) * (n - 1) / n
        fit = here.where("n > 1").agg(F.sum((p - m) * (p - m) - m * (1 - m) / n).alias("over"), F.sum(wide).alias("span"))
        # over / span estimates 1 / (s + 1); it is held between 1/1001 and 1/2.
        rho = F.greatest(F.least(F.coalesce(F.col("over") / F.col("span"), F.lit(0.5)), F.lit(0.5)), F.lit(1 / 1001))
        strength = fit.select(F.lit(1).alias("_all"), (1 / rho - 1).alias("s"))
        # open: what unlabelled levels down to this one leave of m(1-m) as variance; 0 for a level with labels.
        spread = F.when(n > 0, 0.0).otherwise(1 - (1 - F.col("open")) * F.col("s") / (F.col("s") + 1))
        here = here.join(strength, "_all").withColumn("open", spread)
        s = F.when(n > 0, F.col("s")).otherwise(1 / F.nullif(F.col("open"), F.lit(0.0)) - 1)
        a, b = s * m + F.col("bad"), s * (1 - m) + n - F.col("bad")
        here = here.select(*keys, "n", "bad", "open", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))
        above, parent = here.select(*keys, F.col("mean").alias("prior"), "open"), level
    return here.select(*LEVELS, "n", "bad", "mean", F.greatest(F.col("mean") - z * F.col("sd"), F.lit(0.0)).alias("bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and source (`rule`, `host` or `default`) for every page.

    labels: (page_id, bad 0/1); rows with a null in either are no evidence, repeated rows count once per page and outcome row.
    A page without a fitting rule is blocked when its host's posterior bound is above the threshold, whether or not a page of
    that host is labelled; without any label nothing is known and all hosts are allowed. A null URL or one without `://` has an empty host and path. Empty tables give empty results or only
    allowed pages; other columns are ignored. Only built-in functions are used.
    """
    host, path = parse(F.col("url"))
    judged = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", name.alias("rule"), verdict.alias("_ruled"))
    known = labels.select("page_id", "bad").where("page_id IS NOT NULL AND bad IS NOT NULL")
    outcomes = judged.select("page_id", "host").join(known, "page_id").select("host", "bad")
    blocked = reputations(outcomes, hosts=judged.select("host")).where(F.col("bound") > threshold).select("host", F.lit(1).alias("_bad"))
    out = judged.join(blocked, "host", "left")
    by_host = F.when(F.col("_bad") == 1, F.lit("block")).otherwise("allow")
    source = F.when(F.col("_ruled").isNotNull(), F.lit("rule")).when(F.col("_bad") == 1, F.lit("host")).otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_host).alias("verdict"), source.alias("source"))


ORACLE = r"""WITH parts AS (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM named),
cut AS (SELECT host, toxic AS bad, string_split(regexp_replace(host, ':\d*$', ''), '.') AS l FROM named JOIN labels ON page_id = doc_id WHERE toxic IS NOT NULL),
two AS (SELECT host, bad, l[-1] AS one, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three FROM cut),
leveled AS (SELECT host, bad, CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN two ELSE one END AS suffix,
  CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN three ELSE two END AS domain FROM two),
total AS (SELECT (sum(bad) + 0.5::DOUBLE) / (count(*) + 1) AS prior FROM leveled),
c1 AS (SELECT suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(prior) AS m FROM leveled, total GROUP BY suffix),
s1 AS (SELECT 1 / greatest(least(coalesce(sum((bad / n - m) * (bad / n - m) - m * (1 - m) / n) / sum(m * (1 - m) * (n - 1) / n), 0.5::DOUBLE), 0.5::DOUBLE), 1::DOUBLE / 1001) - 1 AS s FROM c1 WHERE n > 1),
p1 AS (SELECT suffix, (s * m + bad) / (s + n) AS mean FROM c1, s1),
c2 AS (SELECT suffix, domain, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(mean) AS m FROM leveled JOIN p1 USING (suffix) GROUP BY 1, 2),
s2 AS (SELECT 1 / greatest(least(coalesce(sum((bad / n - m) * (bad / n - m) - m * (1 - m) / n) / sum(m * (1 - m) * (n - 1) / n), 0.5::DOUBLE), 0.5::DOUBLE), 1::DOUBLE / 1001) - 1 AS s FROM c2 WHERE n > 1),
p2 AS (SELECT suffix, domain, (s * m + bad) / (s + n) AS mean FROM c2, s2),
c3 AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(mean) AS m FROM leveled JOIN p2 USING (suffix, domain) GROUP BY 1),
s3 AS (SELECT 1 / greatest(least(coalesce(sum((bad / n - m) * (bad / n - m) - m * (1 - m) / n) / sum(m * (1 - m) * (n - 1) / n), 0.5::DOUBLE), 0.5::DOUBLE), 1::DOUBLE / 1001) - 1 AS s FROM c3 WHERE n > 1),
post AS (SELECT host, s * m + bad AS a, s * (1 - m) + n - bad AS b FROM c3, s3),
bad_hosts AS (SELECT host FROM post WHERE a / (a + b) - 1.6448536269514722::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.2)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM bad_hosts) THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN host IN (SELECT host FROM bad_hosts) THEN 'host' ELSE 'default' END AS source FROM ruled"""
