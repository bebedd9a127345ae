"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule names a host and a path prefix and holds for the host and all its subdomains; of the rules that hold the
longest decides. URLs without a rule are judged by boosted trees trained on labelled URLs, by default those that the
rules label. Features are lexical (lengths, depth, digit ratio, entropy, counts) and, for the host's last two labels,
statistics over the whole table. Everything is column expressions and the JVM's tree learner: no Python runs on the
executors. Training takes a bounded sample of the distinct labelled URLs, those of the smallest hashes; accuracy() tells
how the trees judge labelled URLs of hosts that they were not trained on.

A null URL or one without `://` has an empty host and path and no rule, and is judged like any other by its features.
Without labelled URLs the verdict is `allow`; with labels of one kind only, that kind. Repeated rows are judged each
and alike. An empty table gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Most labelled URLs that the trees are trained on; trees and their depth.
SAMPLE, TREES, DEPTH = 20000, 12, 4
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens",
    "has_fragment", "suffix_urls", "suffix_hosts", "suffix_depth",
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fits(host: str, path: str) -> Column:
    """A rule on columns host and path."""
    named = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return named & F.startswith(F.col("path"), F.lit(path))


def ruled(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, ruling). The rules are a list in the program, so they are one expression."""
    host, path = split_url(F.col(url))
    out = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    host, path = split_url(F.col("url"))
    out = out.withColumn("host", host).withColumn("path", path)
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:]))
    rule = F.coalesce(*(F.when(fits(h, p), F.lit(h + p)) for _, h, p in order), F.lit(None).cast("string"))
    ruling = F.coalesce(*(F.when(fits(h, p), F.lit(v)) for v, h, p in order), F.lit(None).cast("string"))
    return out.withColumn("rule", rule).withColumn("ruling", ruling)


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    each = F.array_distinct(F.split(text, ""))

    def bits(total, c):
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - F.when((c != "") & (share > 0), share * F.log2(share)).otherwise(0.0)

    return F.when(n > 0, F.aggregate(each, F.lit(0.0), bits)).otherwise(0.0)


def featured(rows: DataFrame) -> DataFrame:
    """rows with the columns FEATURES. The suffix statistics are aggregated before their shuffle and joined back."""
    url = F.coalesce("url", F.lit(""))
    out = rows.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/[^/]+")).cast("double").alias("depth"),
        F.regexp_count("host", F.lit("[^.]+")).cast("double").alias("labels"),
        F.when(F.length(url) > 0, F.regexp_count(url, F.lit("[0-9]")) / F.length(url)).otherwise(0.0).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+")).cast("double").alias("parameters"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.substring_index("host", ".", -2).alias("suffix"),
    )
    stats = out.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_urls"),
        F.log1p(F.approx_count_distinct("host")).alias("suffix_hosts"),
        F.avg("depth").alias("suffix_depth"),
    )
    return out.join(stats, "suffix")


def trained(labelled: DataFrame, sample: int = SAMPLE):
    """Boosted trees on FEATURES of rows with label 0 or 1 and url; None if there are no two kinds of labels."""
    kinds = labelled.agg(F.min("label"), F.max("label")).head()
    if kinds[0] == kinds[1]:
        return kinds[0]
    # a URL counts once, however many rows have it
    rows = labelled.select("url", "label", *FEATURES).distinct()
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(sample).select("label", *FEATURES).repartition(4)
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label", cacheNodeIds=False)
    return learner.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def known_rows(rows: DataFrame, labelled: DataFrame | None) -> DataFrame:
    """The featured rows whose label (1 to block) is given by (url, label), else by the rules."""
    if labelled is None:
        return rows.where("ruling is not null").withColumn("label", (F.col("ruling") == "block").cast("double"))
    # contradicting labels of a URL: block
    labels = labelled.groupBy("url").agg(F.max(F.col("label").cast("double")).alias("label"))
    return rows.join(labels, "url")


def accuracy(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(label, prediction, n): how the trees judge the labelled URLs, each counted once, of one host in five by hash, when
    they are trained on the other hosts' alone."""
    known = known_rows(featured(ruled(pages, rules)), labelled)
    held_out = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    model = trained(known.where(~held_out), sample)
    test = known.where(held_out).select("url", "label", *FEATURES).distinct()
    if model is None or isinstance(model, float):
        test = test.withColumn("prediction", F.lit(float(model or 0)))
    else:
        test = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(test))
    return test.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule (like `net/`; else null), verdict (`allow` or `block`: the rule's, else the trees') of
    every page. labelled: (url, label), 1 to block; else the pages that the rules label."""
    rows = featured(ruled(pages, rules))
    known = known_rows(rows, labelled)
    model = trained(known, sample)
    keep = [F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule"]
    if model is None or isinstance(model, float):
        return rows.select(*keep, F.coalesce("ruling", F.lit("block" if model else "allow")).alias("verdict"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    by_trees = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(*keep, F.coalesce("ruling", by_trees).alias("verdict"))
