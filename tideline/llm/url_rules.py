"""URL filters: association rules over URL tokens, mined by FP-growth, matched by an inverted index.

A short list of stated rules (host and path prefix) settles the URLs that it covers, and these
label the rest: every covered URL is a transaction of tokens and its verdict. All parts of a URL give
tokens; those that are frequent enough to be in a rule are counted first, of tokens that always occur
together one stands for all, and a transaction holds every one that is left. Spark's
FP-growth finds the combinations that imply a verdict; rules below the least support, confidence or
lift are pruned, and so are rules that a shorter one of at least their confidence makes idle. Each
mined rule is indexed under its rarest token, so that a URL meets only rules
that share that token, and fires those whose tokens it holds in full. The most confident rule
decides (ties: higher support, fewer tokens, block before allow, then the tokens' order); where none
fires, the URL is allowed. All of it is DataFrame work; Python declares the plan only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import materialise

#: (verdict, host, path prefix): a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Least share of the covered URLs that hold a mined rule, least confidence, and least lift.
SUPPORT, CONFIDENCE, LIFT = 0.01, 0.8, 1.1
#: A bound on a transaction's tokens, those of the highest lift, that a caller may state: FP-growth then meets at most
#: ``2 ** TOKENS`` sets of each. None is set otherwise, and every frequent set is mined.
TOKENS = 12
#: Most index rows that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of the whole URL: scheme, all host suffixes, all path parts by place, kind of the last part, query names."""
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host:"), F.array_join(F.reverse(F.slice(labels, F.lit(1), k)), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    shape = lambda p: F.regexp_replace(p, "[0-9]+", "0")
    placed = F.transform(parts, lambda p, i: F.concat(F.lit("part"), i.cast("string"), F.lit(":"), shape(p)))
    last = F.concat(F.lit("ends:"), F.regexp_extract(path, r"(/|\.[A-Za-z]{1,5})$", 1))
    digit = F.concat(F.lit("digit:"), F.regexp_extract(path, r"/([0-9])[^/]*/?$", 1))
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    names = F.transform(F.coalesce(query, F.array().cast("array<string>")), lambda q: F.concat(F.lit("query:"), q))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))))
    fragment = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(scheme, suffixes, placed, F.array(last, digit), names, fragment))


def telling_tokens(items: DataFrame, support: float) -> list[str]:
    """Tokens of ``items(tokens, verdict)`` that a rule can hold, of the highest lift first (ties by name).

    Those in at least ``support`` of the rows, which are at most as many as a URL's tokens on average
    over ``support``. Of tokens that occur in the same rows the shortest (then first) stays.
    """
    total = items.count()
    shares = items.groupBy("verdict").agg((F.count("*") / F.lit(max(total, 1))).alias("share"))
    # rows are told apart by two hashes of what they hold, whose sums do not depend on how rows are dealt
    prints = [F.xxhash64("tokens", "verdict", F.lit(k)).cast("decimal(38,0)").alias(f"row{k}") for k in (0, 1)]
    total_of = [F.sum(f"row{k}").alias(f"row{k}") for k in (0, 1)]
    each = items.select("verdict", *prints, F.explode("tokens").alias("token")).groupBy("token", "verdict").agg(F.count("*").alias("n"), *total_of)
    each = each.join(F.broadcast(shares), "verdict")
    known = each.groupBy("token").agg(F.sum("n").alias("n"), *total_of, F.max(F.col("n") / F.col("share")).alias("most")).where(F.col("n") >= support * total)
    kept = known.groupBy("n", "row0", "row1").agg(F.min(F.struct(F.length("token").alias("size"), "token"))["token"].alias("token"), F.max(F.col("most") / F.col("n")).alias("lift"))
    return [r.token for r in kept.orderBy(F.desc(F.round("lift", 9)), "token").select("token").collect()]


def mine_rules(covered: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, tokens: int | None = None) -> DataFrame:
    """(antecedent, verdict, confidence, support) mined from ``covered(url, verdict)``, written once.

    All frequent tokens of a URL take part, unless a bound of ``tokens`` is stated.
    """
    items = materialise(covered.select(url_tokens(F.col("url")).alias("tokens"), "verdict"), "url-items")
    frequent = F.array(*[F.lit(t) for t in telling_tokens(items, support)]).cast("array<string>")
    own = F.array_intersect(frequent, F.col("tokens"))
    own = own if tokens is None else F.slice(own, 1, tokens)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items.select(F.concat(own, F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items")))
    verdict = F.col("consequent")[0]
    found = model.associationRules.where(verdict.startswith("verdict=") & (F.col("lift") >= lift))
    mined = materialise(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(verdict, len("verdict=") + 1, 64).alias("verdict"), "confidence", "support"), "url-rules")
    # without one of its tokens, is a rule as sure? Then it never decides
    shorter = mined.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token")).withColumn("rest", F.array_remove("antecedent", F.col("token")))
    other = mined.select(F.col("antecedent").alias("rest"), "verdict", F.col("confidence").alias("as_sure"))
    idle = shorter.join(other, ["rest", "verdict"]).where("as_sure >= confidence").select("antecedent", "verdict").distinct()
    return materialise(mined.join(idle, ["antecedent", "verdict"], "left_anti"), "url-kept")


def index_rules(mined: DataFrame) -> DataFrame:
    """The mined rules, each under that of its tokens which the fewest rules share."""
    tokens = mined.select("*", F.explode("antecedent").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"))
    least = tokens.join(shared, "token").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return materialise(least, "url-index")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **mining: float) -> DataFrame:
    """The rows of ``pages`` with host, path, rule and verdict; such columns of the input are replaced.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and are allowed, as
    is every URL when no stated rule covers any. Repeated URLs are judged once and get one verdict
    each; an empty table gives an empty result.
    Very long URLs give as many tokens as they have parts. A URL that very many rows share is judged
    once; rows that a stated rule settles, and null URLs, take no part in any join.
    """
    added = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"), stated_rule(host, path, rules).alias("__stated"))
    covered = pages.select("url", stated_rule(host, path, rules)["verdict"].alias("verdict")).where("verdict is not null")
    index = index_rules(mine_rules(covered, **mining))
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    is_open = F.col("url").isNotNull() & stated_rule(host, path, rules).isNull()
    open_urls = pages.select("url").where(is_open).distinct().withColumn("tokens", url_tokens(F.col("url")))
    met = open_urls.withColumn("token", F.explode("tokens")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("confidence", "support", (-F.size("antecedent")).alias("short"), (F.col("verdict") == "block").alias("strict"), "antecedent")
    judged = met.groupBy("url").agg(F.max_by("verdict", rank).alias("__mined"))
    out = parsed.where(is_open).join(judged, "url", "left").unionByName(parsed.where(~is_open).withColumn("__mined", F.lit(None).cast("string")))
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    return out.select(*columns, "host", "path", F.col("__stated.rule").alias("rule"), F.coalesce("__stated.verdict", "__mined", F.lit("allow")).alias("verdict"))
