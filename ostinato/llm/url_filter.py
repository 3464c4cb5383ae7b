"""URL rules and empirical-Bayes host reputation, in DataFrame expressions only.

Outcomes of pages (bad or not) are counted for each host, registered domain and suffix. At each level a
beta-binomial prior, centred on the level above and as strong as the groups' own spread says (method of
moments), shrinks the group's share of bad pages. A host is blocked where a lower bound of its posterior
is above a threshold: few outcomes never block a host by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels that make a suffix of two labels with a country code (of two letters) after them, as in co.uk or com.br.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "id", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch", "school")
#: Other suffixes of two labels, under which unlike parties have hosts; further ones are a parameter.
SUFFIXES = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "tumblr.com", "vercel.app", "wordpress.com")
#: Words of a page's url that label it as bad, as a rule to block does; a parameter.
BAD_WORDS = ("ads", "adult", "bets", "betting", "casino", "gambling", "jackpot", "lottery", "malware", "pills", "poker", "porn", "slots", "spam", "viagra", "warez", "xxx")
#: Bounds of a prior's strength, in pages; and standard deviations between the posterior's mean and its bound.
WEAKEST, STRONGEST, DEVIATIONS, THRESHOLD = 2.0, 200.0, 1.645, 0.5


def host_of(url: Column) -> Column:
    """From after the first :// to the next of / ? # or the end, A-Z in lower case; empty without :// or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to the next of ? # or the end; empty without :// or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """The host without a port, whether its suffix has two labels, and whether it is a number."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two, last = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    return name, (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*SECOND_LEVEL) | two.isin(*suffixes), name.rlike("^[0-9.]+$|^\\[")


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and the label before it; the host itself where it has no more labels or is a number."""
    name, wide, number = _labels(host, suffixes)
    return F.when(number, name).when(wide, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last label, or the last two where parties register below those."""
    name, wide, number = _labels(host, suffixes)
    return F.when(number, name).when(wide, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def named_bad(host: Column, path: Column, words: tuple[str, ...] = BAD_WORDS) -> Column:
    """Whether one of the words stands in the host or path, apart from other letters."""
    if not words:
        return F.lit(False)
    return F.translate(F.concat(host, path), UPPER, LOWER).rlike(f"(^|[^a-z])({'|'.join(sorted(words))})([^a-z]|$)")


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule like ``example.net/en/`` fits: its host or a subdomain, and the beginning of the path."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def longest_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest of the rules that fit (of equal ones the first by name), or null. A list of rules is a parameter, of hundreds at most."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        out = F.when(fits(rule, host, path), F.lit(rule)).otherwise(out)
    return out


def _strength(moments: DataFrame) -> Column:
    """Method of moments for groups of n pages, y bad, around a mean m: the excess spread gives the prior's pages."""
    var = F.col("m") * (1 - F.col("m"))
    excess = F.sum((F.col("y") - F.col("n") * F.col("m")) ** 2 - F.col("n") * var)
    room = F.sum(F.col("n") * (F.col("n") - 1) * var)
    rho = excess / F.when(room > 0, room)
    strength = F.when(rho > 0, 1 / rho - 1).otherwise(STRONGEST)
    return F.coalesce(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), strength)), F.lit(STRONGEST))


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, bad) rows to host, n, y, mean, bound: the posterior of the share of bad pages of each host.

    bad: 1 or 0; rows with a null in it are unlabelled and count nowhere. An empty table gives an empty one.
    Counts are pre-aggregated, so a host with a third of all rows costs one row for each task.
    """
    counts = outcomes.where("bad is not null and host is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("y"))
    counts = counts.withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", suffix(F.col("host"), suffixes))
    total = counts.agg(((F.sum("y") + 0.5) / (F.sum("n") + 1)).alias("m"))
    up, levels = None, {}
    for level in ("suffix", "domain", "host"):
        keys = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain"]}[level]
        own = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        own = own.withColumn("m", total.scalar()) if up is None else own.join(up, keys[1])
        s = own.agg(_strength(own).alias("s")).scalar()
        own = own.withColumn("s", s)
        a, b = F.col("s") * F.col("m") + F.col("y"), F.col("s") * (1 - F.col("m")) + F.col("n") - F.col("y")
        own = own.withColumn("mean", a / (a + b)).withColumn("bound", a / (a + b) - DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
        up = own.select(level, F.col("mean").alias("m"))
        levels[level] = own
    return levels["host"].select("host", "n", "y", "mean", "bound")


def judge(pages: DataFrame, rules: dict[str, str], bad: Column | None = None, page_id: str = "page_id", url: str = "url", words: tuple[str, ...] = BAD_WORDS, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior mean and bound.

    rules: rule to allow or block; the longest that fits decides. Where none fits, the page is blocked if the lower
    bound of its host's posterior is above THRESHOLD. bad: a column of ``pages``, 1 or 0, or null where a page has no
    label. By default a page's outcome is 1 where one of ``words`` stands in its url or a rule blocks it, and else 0: the
    first doesn't depend on rules, so a host can be blocked of which no page is listed.
    A null url has an empty host and path and fits no rule. Rows with equal or null ids stay apart; empty in, empty out.
    Columns of ``pages`` other than these are not read. Pages of a hot host are spread over all tasks.
    """
    scratch = Scratch(pages.sparkSession, "reputation")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), (bad if bad is not None else F.lit(None)).cast("int").alias("label"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    base = base.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path")))
    listed = F.lit(None).cast("string")
    for verdict in ("allow", "block"):
        if names := [r for r, v in rules.items() if v == verdict]:
            listed = F.when(F.col("rule").isin(*names), F.lit(verdict)).otherwise(listed)
    base = base.withColumn("listed", listed)
    own = named_bad(F.col("host"), F.col("path"), words) | F.coalesce(F.col("listed") == "block", F.lit(False))
    outcome = F.col("label") if bad is not None else own.cast("int")
    known = scratch.save(reputation(base.select("host", outcome.alias("bad")), suffixes).select("host", "n", "mean", "bound"), "hosts")
    out = scratch.spread_join(base, known, "host", F.xxhash64("page_id", "path"))
    method = F.when(F.coalesce(F.col("bound"), F.lit(0.0)) > THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), F.col("mean").alias("posterior_mean"), F.col("bound").alias("posterior_bound"))
