"""URL rules by hashed expressions, with DataFrame functions only.

A rule is a host and the beginning of a path (``example.net/en/``). Each URL is
expanded into the expressions a rule could equal: suffixes of its host with as
many labels as some rule has, joined to prefixes of its path as long as some
rule's path. Expressions and rules meet in an equi-join on the first digits of
their SHA-256, the whole digest confirms the match, and the longest rule wins.

The expansion follows the distinct (labels, path length) shapes of the rules, so
its width depends on the rules and never on a URL's length. Few rules of few shapes
are broadcast, one join for each shape, and URLs are neither copied nor shuffled;
otherwise a URL has one row for each expression until its best rule is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm._common import Scratch

#: Hex digits of the digest that the join compares.
PREFIX_DIGITS = 8
#: Up to so many rules are broadcast; a larger table is joined by shuffle, copied once per salt.
BROADCAST_RULES = 100_000
SALTS = 32
#: Shapes of rules that are joined one after another.
MAX_JOINS = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) rows, such as ``("net/", "block")``."""
    return spark.createDataFrame(rules, "rule string, verdict string")


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES, max_joins: int = MAX_JOINS
) -> DataFrame:
    """page_id, url, host, path, rule and verdict for every row of ``pages``.

    ``rules`` has (rule, verdict). A rule fits its host and all subdomains if the
    URL's path starts with the rule's; the longest rule text wins, then the one
    with the longer host; of rules that repeat a text, the lowest verdict. A URL
    without a host fits none and gets ``default``, as do null and empty ones.
    Repeated rows stay; no other column of ``pages`` is read.
    """
    rules = (
        rules.where("rule is not null")
        .groupBy("rule")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("rule_host", F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER))
        .withColumn("rule_path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
        .withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
        .groupBy("digest")  # hosts are told apart by their lower case alone
        .agg(
            F.size(F.split(F.first("rule_host"), r"\.")).alias("labels"),
            F.length(F.first("rule_path")).alias("chars"),
            F.max(F.struct(F.length("rule").alias("chars"), F.length("rule_host").alias("host_chars"), F.col("rule").alias("fits"), F.col("verdict").alias("says"))).alias("hit"),
        )
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    rules = Scratch(pages.sparkSession, "rules").write(rules)
    shapes = [(r["labels"], r["chars"]) for r in rules.select("labels", "chars").distinct().orderBy("labels", "chars").collect()]
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    if few and len(shapes) <= max_joins:
        best = _join_each(urls, rules, shapes)
    else:
        best = _join_expanded(urls, rules, shapes, few)
    return best.select("page_id", "host", "path", F.col("best.fits").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"), "url")


def _expression(labels: int, chars: int) -> Column:
    """What a rule of this shape would equal; null if the URL is shorter."""
    found = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    return F.when(
        (F.col("host") != "") & (found >= labels) & (F.length("path") >= chars),
        F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)),
    )


def _confirmed(rules: str, full: str) -> Column:
    """Those of a list of rules whose whole digest is the one given."""
    return F.filter(rules, lambda r: r["digest"] == F.col(full))


def _join_each(urls: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``urls`` with their best rule, by a broadcast join for each shape of rules."""
    hits = []
    for k, (labels, chars) in enumerate(shapes):
        own = rules.where((F.col("labels") == labels) & (F.col("chars") == chars))
        # One row for each short prefix, with all rules that have it.
        own = own.groupBy(F.col("short").alias(f"short{k}")).agg(F.collect_list(F.struct("digest", "hit")).alias(f"rules{k}"))
        urls = urls.withColumn(f"full{k}", F.sha2(_expression(labels, chars), 256))
        urls = urls.join(F.broadcast(own), F.substring(f"full{k}", 1, PREFIX_DIGITS) == F.col(f"short{k}"), "left")
        # The whole digest confirms; digests differ among rules, so that one at most is left.
        hits.append(F.get(_confirmed(f"rules{k}", f"full{k}"), F.lit(0))["hit"])
    none = F.lit(None).cast("struct<chars:int,host_chars:int,fits:string,says:string>")
    return urls.withColumn("best", F.array_max(F.array(*hits)) if hits else none)


def _join_expanded(urls: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], few: bool) -> DataFrame:
    """The same by a row for each expression; rules are broadcast if ``few``, else copied for each salt and shuffled."""
    urls = urls.withColumn("row", F.monotonically_increasing_id())
    # One row for a URL that no rule can fit, one per expression otherwise.
    expanded = (
        urls.withColumn("expression", F.explode_outer(F.array_compact(F.array(*[_expression(*shape) for shape in shapes])) if shapes else F.array().cast("array<string>")))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    )
    keep = rules.select("short", "digest", "hit")
    if few:
        joined = expanded.join(F.broadcast(keep), "short", "left")
    else:
        salted = keep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = expanded.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    return joined.groupBy("row", "page_id").agg(
        *[F.first(c).alias(c) for c in ("url", "host", "path")], F.max(F.when(F.col("digest") == F.col("full"), F.col("hit"))).alias("best")
    )
