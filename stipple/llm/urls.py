"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule fits.

The trees learn from the URLs that rules label (allow: 0, block: 1). Features: lengths, depth, digit ratio, character
entropy, counts of parameters, hyphens and host labels, and the smoothed share of blocked URLs per host suffix.
Everything is DataFrame functions and Spark's own tree learner; scoring is one pass without a shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the trees' verdict on its
(then mostly zero) features; without labelled URLs of both kinds, every URL without a rule gets the verdict of the
labelled ones, or allow if there are none; URLs of any length are read whole; rules of equal length and equal scores are settled by their
order and by allow; repeated rows are judged alike; columns besides page_id and url are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .sampling import drawn_by_hash

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: At most about this many labelled URLs are learned from, half of each verdict where there are enough, drawn by the hash of page and URL.
MAX_TRAIN = 20_000
#: Suffix tables up to this many rows are shipped to the executors; larger ones are joined by a shuffle.
SHIPPED_SUFFIXES = 100_000
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_fragment", "f_https", "f_suffix"]
TREES, DEPTH = 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return (
        pages.withColumn("__rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and rule_verdict: of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longer ones are asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def entropy(text: Column) -> Column:
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def with_features(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    features = {
        "f_length": F.length(url),
        "f_host_length": F.length("host"),
        "f_path_length": F.length("path"),
        "f_depth": count(F.col("path"), "/"),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "f_entropy": entropy(url),
        "f_params": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "f_hyphens": count(url, "-"),
        "f_labels": F.when(F.col("host") == "", 0).otherwise(count(F.col("host"), ".") + 1),
        "f_fragment": (F.instr(url, "#") > 0).cast("int"),
        "f_https": F.startswith(url, F.lit("https://")).cast("int"),
    }
    return pages.withColumns({k: v.cast("double") for k, v in features.items()}).withColumn("__suffix", F.substring_index("host", ".", -1))


def suffix_shares(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Labelled URLs (n) and blocked ones (b) of every suffix, and the share of blocked ones of all; from all labelled URLs."""
    blocked = F.sum((F.col("rule_verdict") == "block").cast("int"))
    by = materialize(labelled.groupBy("__suffix").agg(F.count("*").alias("n"), blocked.alias("b")), "url-suffixes")
    total = by.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    return by, (total["b"] or 0) / total["n"] if total["n"] else 0.0


def with_suffix_share(rows: DataFrame, shares: DataFrame, mean: float, own: Column) -> DataFrame:
    """Adds f_suffix, the smoothed share of blocked URLs with the row's suffix. own: the row's share in the counts (1 if it was counted),
    which is left out."""
    few = shares.count() <= SHIPPED_SUFFIXES
    blocked = F.when(F.col("rule_verdict") == "block", own).otherwise(0)
    n, b = F.coalesce("n", F.lit(0)) - own, F.coalesce("b", F.lit(0)) - blocked
    return rows.join(F.broadcast(shares) if few else shares, "__suffix", "left").withColumn("f_suffix", (b + 10 * mean) / (n + 10)).drop("n", "b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_train: int = MAX_TRAIN) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score (null where the class is constant)."""
    rows = with_features(with_rule(with_parts(pages.select("page_id", "url")), rules))
    labelled = rows.where(F.col("rule").isNotNull())
    kinds = {r["rule_verdict"]: r["count"] for r in labelled.groupBy("rule_verdict").count().collect()}
    result = lambda df, score, verdict: df.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", verdict).alias("verdict"), score.alias("score"))
    if len(kinds) < 2:
        return result(rows, F.lit(None).cast("double"), F.lit(next(iter(kinds), "allow")))
    shares, mean = suffix_shares(labelled)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="__features")
    # of each verdict half of the sample, or all if it has fewer; the rest of the half goes to the other
    few, many = sorted(kinds, key=kinds.get)
    of_few = min(kinds[few], max_train // 2)
    wanted = {few: of_few, many: max_train - of_few}
    keep = F.lit(0.0)
    for verdict, count in kinds.items():
        keep = F.when(F.col("rule_verdict") == verdict, min(1.0, wanted[verdict] / count)).otherwise(keep)
    drawn = labelled.where(drawn_by_hash(keep, F.col("page_id").cast("string"), "url") | (keep >= 1))
    weight = F.lit(0.0)
    for verdict, count in kinds.items():
        weight = F.when(F.col("rule_verdict") == verdict, count / min(count, wanted[verdict])).otherwise(weight)
    scale = sum(kinds.values()) / sum(min(n, wanted[v]) for v, n in kinds.items())
    columns = [*FEATURES, (F.col("rule_verdict") == "block").cast("double").alias("__label"), (weight / scale).alias("__weight")]
    train = materialize(with_suffix_share(drawn, shares, mean, F.lit(1)).select(*columns), "url-train")
    if train.groupBy("__label").count().count() < 2:  # by chance none of one kind
        train = materialize(with_suffix_share(labelled, shares, mean, F.lit(1)).select(*columns), "url-train")
    learner = GBTClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False)
    model = learner.fit(assembler.transform(train)).setPredictionCol("__says").setProbabilityCol("__share").setRawPredictionCol("__raw")
    scored = model.transform(assembler.transform(with_suffix_share(rows, shares, mean, F.lit(0))))
    score = vector_to_array("__share")[1]
    return result(scored, score, F.when(score > 0.5, "block").otherwise("allow"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
