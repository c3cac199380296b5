"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features beyond them."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.llm.common import query, read
from duolex.session import materialize

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Host endings are counted in this many hashed groups, so the statistics can be sent to every task.
ENDINGS = 4096
#: The trees are fitted on at most this many labelled URLs, those of the smallest hash.
TRAIN_ROWS = 20_000
FEATURES = (
    "url_length host_length path_length depth labels digit_ratio mark_ratio entropy parameters fragment secure "
    "ending_share ending_digits ending_block"
).split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        F.coalesce(F.translate(host, upper, lower), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent domain) and path, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def lexical_features(pages: DataFrame) -> DataFrame:
    """Adds the features of `url`, `host` and `path` that need no other row."""
    url, n = F.coalesce(F.col("url"), F.lit("")), F.col("url_length")
    spread = F.transform(
        F.array_distinct(F.split(url, "")),
        lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n,
    )
    entropy = F.aggregate(
        F.filter(spread, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    )
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    return (
        pages.withColumn("url_length", F.length(url).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", F.regexp_count("path", F.lit("/")).cast("double"))
        .withColumn("labels", F.regexp_count("host", F.lit("[.]")).cast("double"))
        .withColumn("digit_ratio", F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1.0)))
        .withColumn("mark_ratio", F.regexp_count(url, F.lit("[^0-9A-Za-z]")) / F.greatest(n, F.lit(1.0)))
        .withColumn("entropy", F.when(n > 0, entropy).otherwise(0.0))
        .withColumn("parameters", F.when(asked == "", 0.0).otherwise(F.regexp_count(asked, F.lit("&")) + 1.0))
        .withColumn("fragment", F.contains(url, F.lit("#")).cast("double"))
        .withColumn("secure", F.lower(url).startswith("https:").cast("double"))
        .withColumn("ending", F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(ENDINGS)).cast("int"))
    )


def ending_statistics(judged: DataFrame) -> DataFrame:
    """Over all pages, per hashed host ending: log share, mean digit ratio, smoothed share of blocked."""
    rows = judged.groupBy("ending").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("digit_ratio").alias("ending_digits"),
        F.count("_label").alias("_known"),
        F.coalesce(F.sum("_label"), F.lit(0.0)).alias("_blocked"),
    )
    totals = rows.agg(F.sum("_n"), F.sum("_known"), F.sum("_blocked")).first()
    n, known, blocked = (float(x or 0) for x in totals)
    prior = (blocked + 1.0) / (known + 2.0)
    return rows.select(
        "ending",
        F.log2(F.col("_n") / F.lit(max(n, 1.0))).alias("ending_share"),
        "ending_digits",
        ((F.col("_blocked") + 10.0 * prior) / (F.col("_known") + 10.0)).alias("ending_block"),
    )


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): a verdict for every row of (page_id, url).

    The labelled URLs are those a rule decides; boosted trees learn them from lexical features
    alone and judge the rest, blocking from a score of 0.5. Ending statistics come from all rows.
    Null URLs and such without `://` have an empty host and path, fit no rule and are judged by
    the trees. If no rule or only one verdict occurs, there is nothing to learn: the score is the
    share of blocked URLs among the known ones, or 0. Repeated rows stay; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = lexical_features(rows.withColumns({"rule": rule, "_verdict": verdict})).withColumn(
        "_label", (F.col("_verdict") == "block").cast("double")
    )
    rows = rows.withColumn("_order", F.xxhash64(F.coalesce("url", F.lit("")), "page_id"))
    rows = materialize(rows.drop("url"), "url-features")
    full = rows.join(F.broadcast(ending_statistics(rows)), "ending", "left")
    full = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(full)

    known = full.filter(F.col("_label").isNotNull()).orderBy("_order", "page_id").limit(train_rows)
    known = materialize(known.select("_features", F.col("_label").alias("label")), "url-sample")
    seen = [r[0] for r in known.select("label").distinct().collect()]
    if len(seen) == 2:
        trees = GBTClassifier(featuresCol="_features", maxIter=20, maxDepth=4, stepSize=0.3, seed=7)
        model = trees.setPredictionCol("_said").setProbabilityCol("_odds").setRawPredictionCol("_raw").fit(known)
        scored = model.transform(full).withColumn("score", vector_to_array("_odds")[1])
    else:
        scored = full.withColumn("score", F.lit(float(seen[0]) if seen else 0.0))
    said = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_verdict", said).alias("verdict"), "score")


@query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"))
