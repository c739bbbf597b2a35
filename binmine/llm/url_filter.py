"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled outcomes (bad or not) are counted by host. A host's share of bad pages is shrunk through beta-binomial priors:
the corpus is the prior of a public suffix, the suffix that of a registered domain, the domain that of a host. Each
level's prior strength is fitted by moments from the spread of its groups around their parents. A host is blocked
where the lower bound of its posterior, a quantile of the beta distribution, exceeds a multiple of the corpus's own share.
Explicit rules come first: the longest that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: A small default of suffixes of two or more labels under which names are registered; others have one label. read_suffixes() takes a full list.
DEFAULT_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "com.cn", "co.in", "github.io")
#: A host is blocked if its bad share is, with all but this probability, over LIFT times that of the corpus (MOST at most).
ERROR, LIFT, MOST = 0.05, 1.5, 0.95
#: Steps of the integrals below and above the limit.
STEPS = 400


def read_suffixes(lines: Iterable[str]) -> tuple[str, ...]:
    """The suffixes of two or more labels of a public suffix list; comments, wildcards and exceptions are left out."""
    found = (line.split()[0].lower() for line in lines if line.strip() and not line.lstrip().startswith(("//", "!", "*")))
    return tuple(sorted({s for s in found if "." in s}))


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or without "://"."""
    at = F.locate("://", url)
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule whose host is host or a parent domain of it and whose path starts path, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)).otherwise(out)
    return out


def _name(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")


def suffix_of(host: Column, suffixes: tuple[str, ...] = DEFAULT_SUFFIXES) -> Column:
    """The longest of the suffixes that a host ends in, else its last label."""
    name = _name(host)
    out = F.regexp_extract(name, r"([^.]*)$", 1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        last = F.substring_index(name, ".", -n)
        out = F.when(last.isin([s for s in suffixes if s.count(".") + 1 == n]), last).otherwise(out)
    return out


def domain_of(host: Column, suffixes: tuple[str, ...] = DEFAULT_SUFFIXES) -> Column:
    """The suffix and one label before it; a host without such a label is its own domain, as is an address."""
    name = _name(host)
    suffix = suffix_of(host, suffixes)
    rest = F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0)))
    return F.when(name.rlike(r"^[\d.]+$") | (rest == ""), name).otherwise(F.concat(F.regexp_extract(rest, r"([^.]*)$", 1), F.lit("."), suffix))


def below(a: str, b: str, limit: str, total: str) -> str:
    """SQL of the probability that a beta(a, b) share is at most limit; total is an engine's sum over i of {0}.

    Integrated over the log-odds z, where the density is smooth for any a and b > 0, from both sides of the limit.
    """
    mode, spread, at = f"ln({a} / {b})", f"sqrt(1 / {a} + 1 / {b})", f"ln({limit} / (1 - {limit}))"
    lo, hi = f"({mode} - 12 * {spread} - 40 / {a})", f"({mode} + 12 * {spread} + 40 / {b})"
    log_f = lambda z: f"({a} * {z} - ({a} + {b}) * (greatest({z}, 0) + ln(1 + exp(-abs({z})))))"
    part = lambda x, y: f"(({y} - {x}) / {STEPS} * " + total.format(f"exp({log_f(f'({x} + (i + 0.5) * ({y} - {x}) / {STEPS})')} - {log_f(mode)})") + ")"
    return f"case when {at} <= {lo} then 0.0 when {at} >= {hi} then 1.0 else {part(lo, at)} / ({part(lo, at)} + {part(at, hi)}) end"


def _strength(groups: DataFrame) -> float:
    """The prior's weight in pages, by moments, from groups with n, bad and the parent's share p: one scalar row."""
    row = groups.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("p"), 2) / (F.col("p") * (1 - F.col("p")))).alias("chi"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("nn"),
    ).first()
    rho = ((row.chi or 0.0) - (row.n or 0)) / row.nn if row.nn else 0.0
    return 1.0 / min(max(rho, 1e-4), 0.5) - 1.0


def reputation(outcomes: DataFrame, lift: float = LIFT, error: float = ERROR, suffixes: tuple[str, ...] = DEFAULT_SUFFIXES) -> DataFrame:
    """host, n, bad, posterior (mean bad share), doubt (that the share is within the limit), blocked.

    outcomes: host, n, bad (labelled pages; n may be 0). The limit is lift times the corpus's bad share. Hosts, domains and
    suffixes are counted with pre-aggregation, hosts once. A host without labelled pages has its domain's posterior as its
    prior. Null counts are zero. Without any labelled page every host gets one half and none is blocked.
    """
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts, _ = written(hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), suffixes)), "hosts")
    total = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    p = (total.bad + 1.0) / (total.n + 2.0)
    limit = min(MOST, lift * p)
    by_suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("p", F.lit(p))
    k = _strength(by_suffix)
    by_suffix = by_suffix.select("suffix", ((F.col("bad") + k * F.col("p")) / (F.col("n") + k)).alias("p"))
    by_domain = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(by_suffix, "suffix")
    k = _strength(by_domain)
    by_domain = by_domain.select("suffix", "domain", ((F.col("bad") + k * F.col("p")) / (F.col("n") + k)).alias("p"))
    by_host = hosts.join(by_domain, ["suffix", "domain"])
    k = _strength(by_host)
    shares = by_host.select("host", "n", "bad", (F.col("bad") + k * F.col("p")).alias("a"), (F.col("n") - F.col("bad") + k * (1 - F.col("p"))).alias("b"))
    doubt = F.expr(below("a", "b", f"{limit!r}D", f"aggregate(sequence(0, {STEPS - 1}), 0D, (t, i) -> t + {{0}})"))
    return shares.select("host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("posterior"), doubt.alias("doubt")).withColumn("blocked", F.col("doubt") < error)


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, lift: float = LIFT) -> DataFrame:
    """page_id, host, path, rule, verdict ("allow" or "block") and the host's labelled and bad pages, for each row.

    The verdict is the rule's where one fits (rule is its name), else block where reputation() blocks the host. A null
    or odd url has an empty host, which is judged like any other. Hosts are counted before they meet the pages, and a
    host with very many pages can be split in that join. Repeated rows stay.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    known = reputation(outcomes, lift).select("host", F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), "blocked")
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.name, r.verdict).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow"))
    return rows.join(known, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("host_labelled", F.lit(0)).alias("host_labelled"), F.coalesce("host_bad", F.lit(0)).alias("host_bad"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad: a page's outcome is the label of the document whose number its path names; bad: low quality or toxic.

    Pages without a number or a label count for no outcome, a null url is a page of the empty host. Of repeated labels of
    a document one bad one suffices; a null quality or toxic is not bad. Numbers beyond a long are none.
    """
    ids = pages.select(host_of(F.col("url")).alias("host"), F.expr(r"try_cast(nullif(regexp_extract(url, '/(\\d+)', 1), '') as bigint)").alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("is_bad"))
    return ids.join(known, "doc_id", "left").groupBy("host").agg(F.count("is_bad").alias("n"), F.sum("is_bad").alias("bad"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation for every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_outcomes(pages, table(spark, sf_dir, "labels")))
