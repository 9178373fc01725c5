"""URL verdicts: host and path rules first, boosted trees on lexical features for the rest. DataFrame functions and spark.ml only."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm.common import let, read, shared_table

#: (verdict, host, path) of the rules that the registered query applies.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
FEATURES = ("n_chars", "host_chars", "depth", "labels", "digit_ratio", "entropy", "n_params", "n_dashes", "is_https", "suffix_log_count", "suffix_rate")
#: At most so many labelled URLs, those of the smallest hashes, train the trees.
SAMPLE_ROWS = 20_000
#: A suffix table up to this many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_SUFFIXES = 50_000
#: Weight of the overall rate in a suffix's smoothed rate, and folds of labelled URLs: the rate a labelled URL is trained with leaves its
#: own fold's labels out.
SMOOTHING, FOLDS = 20.0, 5


def parts(pages: DataFrame) -> DataFrame:
    """pages with host (A-Z lower-cased) and path; a null url, or one without ://, has empty ones."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null where none does. Of equal lengths the first in string order wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text).cast("double")

    def bits(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(F.transform(chars, bits), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """pages (with host and path) and their lexical features, suffix statistics left out."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, "[?]([^#]*)", 1)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    return pages.withColumns(
        {
            "suffix": F.element_at(F.split("host", "[.]"), -1),
            "n_chars": F.length(url).cast("double"),
            "host_chars": F.length("host").cast("double"),
            "depth": count(F.col("path"), "/[^/]"),
            "labels": count(F.col("host"), "[^.]+"),
            "digit_ratio": F.when(F.length(url) > 0, count(url, "[0-9]") / F.length(url)).otherwise(0.0),
            "entropy": let(url, _entropy),
            "n_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
            "n_dashes": count(url, "[-_]"),
            "is_https": url.startswith("https://").cast("double"),
        }
    )


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """One row per suffix and fold: log of the suffix's count, and its share of labelled rows that are blocked, smoothed to the whole's.

    The row of a fold leaves the labels of that fold out; the row of fold -1 has all. urls: suffix, fold, label.
    """
    counts = urls.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"))
    each = counts.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.collect_list(F.when(F.col("fold").isNotNull(), F.struct("fold", "labelled", "blocked"))).alias("folds"))  # FOLDS at most
    whole = each.agg((F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1))).alias("base"))
    none = F.array(F.struct(F.lit(-1).alias("fold"), F.lit(0).cast("long").alias("labelled"), F.lit(0.0).alias("blocked")))
    rows = each.crossJoin(F.broadcast(whole)).withColumn("less", F.explode(F.concat("folds", none)))  # whole is a single row
    rate = (F.col("blocked") - F.col("less.blocked") + SMOOTHING * F.col("base")) / (F.col("labelled") - F.col("less.labelled") + SMOOTHING)
    return rows.select("suffix", F.col("less.fold").alias("fold"), F.log1p("n").alias("suffix_log_count"), rate.alias("suffix_rate"))


def train(labelled: DataFrame, seed: int = 7) -> GBTClassificationModel | None:
    """Boosted trees on at most SAMPLE_ROWS rows; None where there are not both labels."""
    sample = shared_table(labelled.orderBy(F.xxhash64("url"), "url").limit(SAMPLE_ROWS).select("features", "label"), "url-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, subsamplingRate=0.8, maxBins=32, seed=seed, checkpointInterval=-1).fit(sample.repartition(1))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, unseen: Column | None = None) -> DataFrame:
    """page_id and url with host, path, rule, score (of the trees, 0 to 1, for block) and verdict (block or allow).

    The labelled URLs are those that a rule decides; their labels where unseen (of page_id and url) is true are kept from training, so
    that score can be held against them. Where labels lack one of the two kinds no trees can be trained: every other URL takes the one
    label there is, or allow. Null and malformed URLs have empty parts and are scored like any other. Repeated rows are judged one by
    one, all in one fold; no rows give no rows; other columns are left aside.
    """
    urls = parts(pages.select("page_id", "url")).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    taught = F.lit(True) if unseen is None else ~F.coalesce(unseen, F.lit(False))
    urls = lexical(urls).withColumn("label", F.when(taught, (F.col("hit.verdict") == "block").cast("double")))
    urls = urls.withColumn("fold", F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    stats = shared_table(suffix_statistics(urls), "url-suffixes")
    if stats.count() <= BROADCAST_SUFFIXES:
        stats = F.broadcast(stats)

    def featured(rows: DataFrame, fold: Column) -> DataFrame:
        joined = rows.withColumn("of_fold", fold).join(stats.select("suffix", F.col("fold").alias("of_fold"), "suffix_log_count", "suffix_rate"), ["suffix", "of_fold"], "left")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)

    labelled = urls.filter(F.col("label").isNotNull())
    model = train(featured(labelled, F.col("fold")))
    if model is None:
        only = labelled.select(F.max("label")).first()[0]
        urls = urls.withColumn("score", F.lit(only or 0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        urls = model.transform(featured(urls, F.lit(-1))).withColumn("score", vector_to_array("probability")[1])
    return urls.withColumns(
        {"rule": F.col("hit.rule"), "verdict": F.coalesce("hit.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))}
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
