"""URL verdicts: rules of hosts and paths, and gradient-boosted trees on lexical features for URLs that no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, stage
from .html_wrappers import host as host_of

#: URLs of each verdict learned from at most, with how many trees and how deep.
SAMPLE_ROWS, TREES, DEPTH = 20_000, 10, 3

#: Statistics of suffixes of at most so many bytes are broadcast; more are joined, where Spark splits suffixes of very many rows.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Hosts, paths and verdicts.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
FEATURES = ["length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "suffix_log_rows", "suffix_length", "suffix_digits"]


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty if null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """The name or verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(getattr(r, value))).otherwise(found)
    return found


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.split(url, "")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / F.length(url)
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": (F.size(F.split(host, r"\.")) * 1.0),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"),
        "digits": F.when(F.length(url) > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / F.length(url)).otherwise(0.0),
        "entropy": F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")) * 1.0),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-")))).cast("double"),
    }


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    The trees learn from a bounded sample of the distinct URLs that rules label, of each verdict, and judge the others: block from a probability of a
    half. Where rules label URLs of one verdict only, that is the verdict of the others; where they label none, it is allow.
    A null url, or one without ://, has an empty host and path; very long ones are taken whole. Repeated rows give a row each; an
    empty table gives none. Other columns, whatever their names, are ignored.
    """
    base = need(pages, "page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules, "name")).withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules, "verdict"))
    base = base.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("text", F.coalesce("url", F.lit("")))
    suffixes = base.groupBy("suffix").agg(F.log1p(F.count("*")).alias("suffix_log_rows"), F.avg(F.length("text")).alias("suffix_length"), F.avg(F.length(F.regexp_replace("text", "[^0-9]", ""))).alias("suffix_digits"))
    suffixes = stage(suffixes, "suffixes")
    few = (suffixes.agg(F.sum(F.length("suffix") + 40)).first()[0] or 0) <= BROADCAST_BYTES
    full = base.join(F.broadcast(suffixes) if few else suffixes, "suffix").withColumns(_lexical(F.col("text"), F.col("host"), F.col("path")))
    full = stage(full.select("page_id", "host", "path", "rule", "by_rule", "text", *FEATURES), "urls")
    urls = full.filter("by_rule IS NOT NULL").dropDuplicates(["text"])
    allowed, blocked = (urls.filter(F.col("by_rule") == v).orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS) for v in ("allow", "block"))
    labelled = allowed.unionByName(blocked)
    labelled = stage(labelled.withColumn("label", (F.col("by_rule") == "block").cast("double")).select("label", *FEATURES), "labelled")
    seen = {r["label"] for r in labelled.select("label").distinct().collect()}
    if len(seen) == 2:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(assembler.transform(labelled))
        scored = trees.transform(assembler.transform(full)).withColumn("score", vector_to_array("probability")[1])
        verdict = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    else:
        scored, verdict = full, F.lit("block" if seen == {1.0} else "allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", verdict).alias("verdict"))
