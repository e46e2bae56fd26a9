"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host. A host's rate is shrunk towards its registered domain's,
that towards its public suffix's, and that towards the rate of all: at each level the parent's posterior mean is the
mean of a beta prior whose strength comes from the data (beta-binomial, method of moments over all groups of the
level). A host is blocked if even the upper posterior bound of its good rate is below a threshold, so hosts with few
or no labels are not blocked for lack of evidence. An ordered rule list (host with its subdomains, path prefix)
overrides the method.

All native: counts are aggregated before the shuffle, level tables have a row per host, domain or suffix, and the join
back to the pages is one that adaptive execution can split when one host holds a third of them.

Registered domains come from a public-suffix list, whose rules (plain, `*.` and `!`) are a parameter: a file of the
public list's format (`read_suffixes`), or the short list made here. User names and ports do not belong to a name; an
address in numbers is a domain and suffix of its own.

Defined results: a null url or one without ``://`` has an empty host and path and is judged like any host; pages
without a label take their host's posterior; of rules of one length that fit the first given wins; several labels of a page all count; null outcomes do not count; without
any label everything that no rule blocks is allowed; very long urls are taken whole; rows that repeat a page are judged
alike, and each counts for its host; an empty table gives an empty result; extra columns are not read, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.store import materialize

URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labels under a country's domain below which names are registered, for countries where that is usual.
SECOND_LABELS = {
    "ar": "com edu gob int mil net org",
    "au": "asn com edu gov id net org",
    "br": "com edu gov mil net org",
    "cn": "ac com edu gov mil net org",
    "hk": "com edu gov idv net org",
    "id": "ac co go mil net or sch web",
    "il": "ac co gov muni net org",
    "in": "ac co edu firm gen gov ind net org res",
    "jp": "ac ad co ed go gr lg ne or",
    "ke": "ac co go ne or sc",
    "kr": "ac co go ne or pe re",
    "mx": "com edu gob net org",
    "my": "com edu gov mil net org",
    "ng": "com edu gov net org",
    "nz": "ac co geek gen govt iwi maori net org school",
    "pk": "com edu gov net org",
    "pl": "com edu gov info net org",
    "sg": "com edu gov net org per",
    "th": "ac co go in mi net or",
    "tr": "bel com edu gov k12 net org",
    "tw": "com edu gov idv net org",
    "ua": "com edu gov in net org",
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "za": "ac co gov law net nom org web",
}
# Names under which a host lets anyone have a name of their own, so each such name is a site by itself.
SHARED_HOSTS = (
    "appspot.com", "azurewebsites.net", "bitbucket.io", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "glitch.me", "herokuapp.com", "myshopify.com",
    "neocities.org", "netlify.app", "onrender.com", "pages.dev", "readthedocs.io", "surge.sh", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com", "workers.dev",
)
#: Public suffixes of several labels, besides the one-label ones. A parameter.
SUFFIXES = frozenset((*SHARED_HOSTS, *(f"{second}.{country}" for country, labels in SECOND_LABELS.items() for second in labels.split())))
#: Largest suffix list, in bytes, and most labels of a suffix.
MAX_SUFFIX_BYTES, MAX_LABELS = 4 << 20, 6
#: Strength of a prior, in pages, stays between these whatever the moments say.
STRENGTH_BOUNDS = (1.0, 1000.0)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PATTERN, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def read_suffixes(path: str) -> frozenset[str]:
    """The rules of a public-suffix list: one a line, `//` begins a comment. The file's size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_SUFFIX_BYTES + 1)
    if len(data) > MAX_SUFFIX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_SUFFIX_BYTES} bytes")
    lines = (line.split("//")[0].split() for line in data.decode().splitlines())
    return frozenset(words[0].lower().rstrip(".") for words in lines if words)


def name_of(host: Column) -> Column:
    """A host without user name, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(?::[0-9]*|\.)$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+)*$") | name.startswith("[")


def _suffix_labels(name: Column, suffixes: frozenset[str]) -> Column:
    """Number of labels of a name's public suffix: the longest rule that fits, one more under a `*.`, one less for a `!`."""
    labels = F.size(F.split(name, r"\."))

    def among(rules: list[str], value: Column) -> Column:
        return value.isin(*rules) if rules else F.lit(False)

    by_size: dict[int, list[str]] = {}
    for r in sorted(suffixes):
        by_size.setdefault(r.count(".") + 1, []).append(r)
    known = F.lit(1)
    for n in sorted(by_size):
        if n > MAX_LABELS:
            raise ValueError(f"a suffix has more than {MAX_LABELS} labels")
        plain, stars = [r for r in by_size[n] if r[0] not in "*!"], [r[2:] for r in by_size[n] if r.startswith("*.")]
        fits = among(plain, F.substring_index(name, ".", -n)) | (among(stars, F.substring_index(name, ".", -(n - 1))) & (labels >= n))
        known = F.when(fits & (labels >= n), F.lit(n)).otherwise(known)
    for n in sorted(by_size):
        known = F.when(among([r[1:] for r in by_size[n] if r.startswith("!")], F.substring_index(name, ".", -n)), F.lit(n - 1)).otherwise(known)
    return known


def _last_labels(name: Column, n: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), ".")


def suffix_of(host: Column, suffixes: frozenset[str] = SUFFIXES) -> Column:
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(_last_labels(name, _suffix_labels(name, suffixes)))


def domain_of(host: Column, suffixes: frozenset[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more."""
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(_last_labels(name, _suffix_labels(name, suffixes) + 1))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. Ties go to the earlier rule."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, parent_mean: str) -> Column:
    """A one-row aggregate: prior strength by the beta-binomial's moments over groups (n, good, parent mean)."""
    n, y, m = F.col("n"), F.col("good"), F.col(parent_mean)
    spread = F.sum(n * F.pow(y / n - m, 2))
    plain = F.sum(m * (1 - m))
    extra = F.sum(m * (1 - m) * (n - 1))
    rho = F.when(extra > 0, (spread - plain) / extra).otherwise(F.lit(0.0))
    low, high = STRENGTH_BOUNDS
    return F.when(rho <= 1 / (high + 1), F.lit(high)).when(rho >= 1 / (low + 1), F.lit(low)).otherwise(1 / rho - 1)


def reputation(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", suffixes: frozenset[str] = SUFFIXES) -> DataFrame:
    """(host, n, good, a, b): the beta posterior of every host of pages. outcomes: (page_id, good boolean)."""
    good = outcomes.filter("good is not null").groupBy(F.col(page_id).alias("_page")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    rows = pages.select(F.col(page_id).alias("_page"), host_of(F.col(url)).alias("host"))
    hosts = rows.join(good, "_page", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = materialize(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "hosts")
    levels = [["suffix"], ["suffix", "domain"], ["suffix", "domain", "host"]]
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = ((whole["good"] or 0) + 1) / ((whole["n"] or 0) + 2)
    above: DataFrame | None = None
    for k, keys in enumerate(levels):
        level = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good")) if k < 2 else hosts.select(*keys, "n", "good")
        level = level.withColumn("prior", F.lit(mean)) if above is None else level.join(above, levels[k - 1])
        level = materialize(level, f"level{k}")
        strength = level.filter("n > 0").agg(_strength(level, "prior").alias("s")).first()["s"] or STRENGTH_BOUNDS[1]
        posterior = level.withColumn("a", F.lit(strength) * F.col("prior") + F.col("good")).withColumn("b", F.lit(strength) * (1 - F.col("prior")) + F.col("n") - F.col("good"))
        above = posterior.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))
    return posterior.select("host", "n", "good", "a", "b")


def upper_bound(a: Column, b: Column, z: float) -> Column:
    """Upper bound of a beta variable by a normal approximation of its logit."""
    return 1 / (1 + F.exp(-(F.log(a / b) + z * F.sqrt(1 / a + 1 / b))))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], min_good: float = 0.5, z: float = 1.96, page_id: str = "page_id", url: str = "url", suffixes: frozenset[str] = SUFFIXES) -> DataFrame:
    """Every page's (page_id, host, path, rule, verdict, good_upper)."""
    known = reputation(pages, outcomes, page_id, url, suffixes).select(F.col("host").alias("_host"), upper_bound(F.col("a"), F.col("b"), z).alias("good_upper"))
    known = materialize(known, "reputation")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("good_upper") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    joined = rows.join(known, rows["host"] == known["_host"], "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "good_upper")
