"""URL filters: given host and path rules first, then association rules mined by FP-growth.

Native: DataFrame functions and Spark's FP-growth only.  A url becomes a basket of tokens (host suffixes, host labels and their words, path words, query keys, scheme;
numbers become one token).  Labelled urls are mined: FP-growth finds the token combinations that ``need`` blocked urls hold, whole baskets without a bound on
their length; those combinations are then counted in all labelled urls, and the ones of enough confidence and lift are the rules.
Of these all stay that are more confident than each rule on a part of their tokens: where another fires, one that stays fires too and is no less confident, so
verdicts and confidences are those of all rules.

The index files a rule under its rarest token only.  Urls are judged once per distinct basket: a basket meets the rules filed under its tokens, those fire of which it
holds every token, and the verdicts go back to the pages by the basket's hash.

Labels are a table of urls that are known to be good or bad.  Where none is given, the pages' own names label them: a url is bad if a word of its host is on a list
of topic words (``TOPICS``), else it counts as good.  Mining then finds the words and combinations that keep such company, also on hosts that no listed word is in.

Rows: a null url or one without ``://`` has empty host and path, an empty basket, no rule, and is allowed; repeated rows are judged alike, and each counts in mining; of rules
that are equally confident the one of the largest id is named; labels with a null url or verdict are not used; with no labels, or no rule that passes, all that no
given rule fits is allowed; very long urls have as many tokens as they have words; other columns aren't read.  Tokens that are frequent among bad urls and occur
together by the dozen make exponentially many combinations, as in any FP-growth.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: (host, path, verdict)
GIVEN_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words of host names that stand for what is filtered: adult, gambling, pharmacy, advertising, spam and pirated software
TOPICS = ("adult", "ads", "bet", "bets", "betting", "casino", "gambling", "pharmacy", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")


@dataclass(frozen=True)
class RuleParams:
    """A rule's tokens are in ``min_support`` of the labelled urls and in ``min_count`` of them as bad ones at least."""

    min_support: float = 0.001
    min_count: int = 5
    min_confidence: float = 0.6
    min_lift: float = 1.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given(host: Column, path: Column, rules=GIVEN_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_words(host: Column) -> Column:
    return F.filter(F.split(host, r"[.\-_]"), lambda x: x != "")


def topic_labels(pages: DataFrame, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """(url, blocked) of the pages' urls that have a host, by the words of the host."""
    url = F.col("url").cast("string")
    own = pages.select(url.alias("url"), host_of(url).alias("host")).where(F.col("host") != "")
    return own.select("url", F.arrays_overlap(host_words(F.col("host")), F.array(*(F.lit(t) for t in topics))).alias("blocked"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct, sorted tokens of a url."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k <= F.least(n, F.lit(4))),
        lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")),
    )
    numberless = lambda c: F.regexp_replace(c, r"\d+", "0")
    words = F.filter(F.split(path, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    keys = F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")
    parts = [
        suffixes,
        F.transform(host_words(host), lambda x: F.concat(F.lit("word:"), numberless(x))),
        F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("sub:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("path:"), numberless(x))),
        F.transform(keys, lambda x: F.concat(F.lit("query:"), numberless(F.split(x, "=")[0]))),
        F.when(F.lower(url).startswith("http:"), F.array(F.lit("scheme:http"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(*parts))))


def mine(labelled: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Block rules (rule_id, items, confidence, support, rare) from rows (items array<string>, blocked boolean), without those that a rule on a part of their tokens makes needless."""
    p, spark = params, labelled.sparkSession
    scratch = Scratch(spark, "url-rules")
    rows = scratch.table(labelled.where((F.size("items") > 0) & F.col("blocked").isNotNull()).groupBy("items").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad")), "baskets")
    total, bad = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    need = max(math.ceil(p.min_support * total), p.min_count, 1)
    if bad < need:
        return spark.createDataFrame([], "rule_id long, items array<string>, confidence double, support double, rare string")
    # a rule's tokens are together in so many bad urls, so the bad ones alone tell what can be a rule; each counts as often as it occurs
    blocked = rows.where("bad > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("bad")))).select("items")
    found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / bad).fit(blocked).freqItemsets
    sets = scratch.table(found.select(F.array_sort("items").alias("items"), F.col("freq").alias("hits")).withColumn("rule_id", F.xxhash64("items")), "sets")
    # all labelled urls that hold a set, found by its rarest token
    held = rows.select(F.explode("items").alias("rare"), F.col("items").alias("basket"), "n")
    count = held.groupBy("rare").agg(F.sum("n").alias("n"))
    rare = sets.select("rule_id", F.explode("items").alias("rare")).join(count, "rare").groupBy("rule_id").agg(F.min(F.struct("n", "rare"))["rare"].alias("rare"))
    filed = scratch.table(sets.join(rare, "rule_id"), "filed")
    hits = filed.select("rule_id", "rare", "items").join(held, "rare").where(F.size(F.array_except("items", "basket")) == 0).groupBy("rule_id").agg(F.sum("n").alias("n"))
    rules = filed.join(hits, "rule_id").withColumns({"confidence": F.col("hits") / F.col("n"), "support": F.col("hits") / F.lit(total)})
    rules = rules.where((F.col("confidence") >= p.min_confidence) & (F.col("confidence") >= p.min_lift * bad / total))
    return _needed(scratch.table(rules.select("rule_id", "items", "confidence", "support", "rare"), "rules"), scratch)


def _needed(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """The rules that are more confident than every rule on a proper part of their tokens."""
    sizes = sorted(r[0] for r in rules.select(F.size("items")).distinct().collect())
    kept = None
    for n in sizes:
        own = rules.where(F.size("items") == n)
        if kept is not None:
            tokens_ = own.select("rule_id", "confidence", F.explode("items").alias("token"))
            parts = kept.select(F.col("rule_id").alias("part"), F.col("confidence").alias("least"), F.size("items").alias("needed"), F.explode("items").alias("token"))
            met = tokens_.join(parts, "token").where(F.col("least") >= F.col("confidence")).groupBy("rule_id", "part", "needed").count()
            own = own.join(met.where(F.col("count") == F.col("needed")).select("rule_id").distinct(), "rule_id", "left_anti").select(*rules.columns)
        own = scratch.table(own, f"rules-{n}")
        kept = own if kept is None else kept.unionByName(own)
    return rules if kept is None else kept


def judge(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(basket, rule_id, confidence): the strongest rule whose tokens the basket holds; baskets without one are absent."""
    index = rules.select("rule_id", "confidence", F.col("items").alias("wanted"), F.col("rare").alias("token"))
    met = baskets.select("basket", "items", F.explode("items").alias("token")).join(index, "token").where(F.size(F.array_except("wanted", "items")) == 0)
    best = F.max(F.struct("confidence", "rule_id")).alias("best")
    return met.groupBy("basket").agg(best).select("basket", F.col("best.rule_id").alias("rule_id"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, params: RuleParams = RuleParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence of every page; ``labels`` (url, blocked) are the urls to learn from."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = given(F.col("host"), F.col("path"))
    parsed = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    known = (topic_labels(pages) if labels is None else labels.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("boolean").alias("blocked"))).where(F.col("url").isNotNull())
    rules = mine(known.select(tokens(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("items"), "blocked"), params)
    parsed = parsed.withColumn("basket", F.xxhash64("items"))
    open_ = parsed.where(F.col("rule").isNull() & (F.size("items") > 0))
    verdicts = judge(open_.groupBy("basket").agg(F.first("items").alias("items")), rules)
    return parsed.join(verdicts, "basket", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("given"), F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("rule_id")).alias("mined_rule"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"),
    )
