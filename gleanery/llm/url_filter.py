"""URL filters: explicit rules, and an empirical-Bayes reputation of hosts for what no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import fresh, lower_ascii, materialize

#: The rules of the registered query, as its contract lists them.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The rules in the registered SQL: it still has the words of the two net rules the other way round.
SQL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"))
#: A host is blocked when its share of bad pages is above LIMIT by Z posterior deviations.
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
# Words of a url (runs of letters) that mark a page as unwanted, and public suffixes of two labels.
BAD_WORDS = "adult ads bet bets betting casino casinos cheap escort gambling hentai loan loans malware phishing pill pills poker porn porno sex slots spam torrent tracker viagra warez xxx".split()
SUFFIXES = "ac.in ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.bd com.br com.cn com.co com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.pl com.sa com.sg com.tr com.tw com.ua com.vn edu.au edu.cn gen.tr go.jp go.kr gob.mx gov.au gov.br gov.cn gov.in gov.uk ltd.uk me.uk ne.jp net.au net.br net.cn net.nz net.uk or.jp or.kr org.au org.br org.cn org.nz org.uk org.za sch.uk".split()
#: A page whose html has fewer words outside markup, scripts and styles is a bad outcome.
LEAST_WORDS = 20

_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and what it says; null where none fits."""
    which, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        which, says = F.when(fits, rule).otherwise(which), F.when(fits, action).otherwise(says)
    return which, says


def _strength(rows: DataFrame) -> tuple[float, float]:
    """Overall rate and prior strength (pages) of a level's groups with counts n and bad, by moments of the beta-binomial."""
    s = rows.where("n > 0").agg(F.sum("n").alias("n"), F.sum("bad").alias("k"), F.count("*").alias("g"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("kk")).first()
    if not s.n:
        return 0.5, WEAKEST
    rate = (s.k + 0.5) / (s.n + 1)
    spread = s.kk - 2 * rate * s.k + rate * rate * s.n
    room = s.n - s.nn / s.n
    between = (spread - (s.g - 1) * rate * (1 - rate)) / room if room > 0 else 0.0
    return rate, STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, rate * (1 - rate) / between - 1))


def site_of(host: Column) -> Column:
    """The host without user and port, which is what reputation belongs to."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def page_outcome(url: Column, html: Column | None = None) -> Column:
    """1 (bad) where the url holds a word of ``BAD_WORDS`` or the html fewer than ``LEAST_WORDS`` words, 0 for other pages with html, null where there is nothing to judge by."""
    words = F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    marked = F.arrays_overlap(words, F.array(*map(F.lit, BAD_WORDS)))
    if html is None:
        return F.when(marked, 1).when(url.isNotNull(), 0)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " "), "<[^>]*>", " ")
    return F.when(marked, 1).when(F.regexp_count(plain, F.lit(r"[^\x20\x09-\x0D]+")) < LEAST_WORDS, 1).when(html.isNotNull(), 0)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, rate and bound of every host in ``outcomes`` (columns host, outcome: 1 bad, 0 good, null not labelled).

    A host's rate is shrunk towards that of its registered domain (one label before a public suffix), the domain's
    towards that of its suffix (``SUFFIXES``, else the last label), the suffix's towards the overall rate; each
    level's prior strength comes from the spread between its groups. bound is the posterior mean less ``Z`` posterior
    deviations. Counts are pre-aggregated, so a host with a third of the pages is one row for each task.
    """
    counts = outcomes.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("bad"))
    labels, last = F.split("host", r"\."), lambda k: F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - (k - 1), F.lit(1)), k), ".")
    double = last(2).isin(SUFFIXES)
    hosts = materialize(counts.withColumn("suffix", F.when(double, last(2)).otherwise(F.element_at(labels, -1))).withColumn("domain", F.when(double, last(3)).otherwise(last(2))), "hosts")
    total = lambda key, *more: hosts.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    shrunk = lambda k, n, prior, s: (F.col(k) + F.lit(s) * prior) / (F.col(n) + F.lit(s))
    suffixes = materialize(total("suffix"), "suffixes")
    rate, of_suffix = _strength(suffixes)
    suffixes = suffixes.select("suffix", shrunk("bad", "n", F.lit(rate), of_suffix).alias("suffix_rate"))
    domains = materialize(total("domain", "suffix"), "domains")
    _, of_domain = _strength(domains)
    domains = materialize(domains.join(suffixes, "suffix").select("domain", shrunk("bad", "n", F.col("suffix_rate"), of_domain).alias("domain_rate")), "domains")
    _, of_host = _strength(hosts)
    known = hosts.join(domains, "domain").withColumn("rate", shrunk("bad", "n", F.col("domain_rate"), of_host))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + of_host + 1))
    return known.select("host", "n", "bad", "rate", (F.col("rate") - Z * deviation).alias("bound"))


def judge_urls(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced, all others are kept.

    A rule's verdict wins; other pages are blocked if their host's posterior bound is above ``LIMIT``. Outcomes come
    from ``outcomes`` (host, outcome), by default from every page itself (``page_outcome``; column html counts where
    there is one); rules are policy and no evidence against a host. Null urls and urls without :// have empty host
    and path and belong to one nameless host, which no outcome reaches. Repeated rows count as often as they occur,
    urls and html of any length whole. The rules are a short list given by the caller.
    """
    plain = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    which, says = rule_for(F.col("host"), F.col("path"), rules)
    rule_says, site, bad = (fresh(plain, x) for x in ("says", "site", "bad"))
    ruled = plain.withColumn("rule", which).withColumn(rule_says, says).withColumn(site, site_of(F.col("host")))
    if outcomes is None:
        html = F.col("html") if "html" in pages.columns else None
        outcomes = pages.select(site_of(host_of(F.col("url"))).alias("host"), page_outcome(F.col("url"), html).alias("outcome"))
    known = materialize(host_reputation(outcomes).where(F.col("bound") > LIMIT).select(F.col("host").alias(site), F.lit(True).alias(bad)), "bad-hosts")
    met = ruled.join(known, site, "left")
    method = F.when(F.col(bad) & (F.col("host") != ""), "block").otherwise("allow")
    return met.withColumn("verdict", F.coalesce(F.col(rule_says), method)).drop(rule_says, bad, site)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _op6_sql() -> str:
    fits = [(r, a, f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')") for a, r in sorted(SQL_RULES, key=lambda x: (-len(x[1]), x[1]))]
    pick = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits) + " END"
    level = lambda name, table: (
        f"{name} AS (SELECT rate, CASE WHEN between_ <= 0 OR between_ IS NULL THEN {STRONGEST} ELSE least({STRONGEST}, greatest({WEAKEST}, rate * (1 - rate) / between_ - 1)) END AS s FROM "
        f"(SELECT rate, CASE WHEN n - nn / n > 0 THEN (kk - 2 * rate * k + rate * rate * n - (g - 1) * rate * (1 - rate)) / (n - nn / n) END AS between_ FROM "
        f"(SELECT *, (k + 0.5) / (n + 1) AS rate FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS k, count(*) AS g, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS kk FROM {table} WHERE n > 0))))"
    )
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    return rf"""
WITH u AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM pages),
r AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS site, {pick(0)} AS rule, {pick(1)} AS says FROM u),
o AS (SELECT site, CASE WHEN list_has_any(regexp_extract_all(lower(coalesce(url, '')), '[a-z]+'), [{quoted(BAD_WORDS)}]) THEN 1
  WHEN len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+')) < {LEAST_WORDS} THEN 1 WHEN html IS NOT NULL THEN 0 END AS outcome FROM r),
l AS (SELECT site AS host, count(outcome) AS n, count(*) FILTER (outcome = 1) AS bad, string_split(site, '.') AS labels, array_to_string(string_split(site, '.')[-2:], '.') IN ({quoted(SUFFIXES)}) AS double FROM o GROUP BY site),
h AS (SELECT host, n, bad, CASE WHEN double THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix, CASE WHEN double THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM l),
sx AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix), dx AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
{level("ls", "sx")}, {level("ld", "dx")}, {level("lh", "h")},
sr AS (SELECT suffix, (bad + s * rate) / (n + s) AS suffix_rate FROM sx, ls), dr AS (SELECT domain, (bad + s * suffix_rate) / (n + s) AS domain_rate FROM dx JOIN sr USING (suffix), ld),
hr AS (SELECT host, n, s, (bad + s * domain_rate) / (n + s) AS rate FROM h JOIN dr USING (domain), lh),
bad AS (SELECT host FROM hr WHERE rate - {Z} * sqrt(rate * (1 - rate) / (n + s + 1)) > {LIMIT})
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN host <> '' AND site IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM r"""


OP6_SQL = _op6_sql()
