"""URL filter: rules on host and path, and for other urls logistic regression on hashed character n-grams. All in the JVM."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host and path as one text) that fits; a rule fits its host and all subdomains."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.find("/") if "/" in rule else len(rule)
        name, start = rule[:at], rule[at:]
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith(start), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def grams(host: Column, path: Column, widths: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of host and path, marked by where they come from; ``^`` and ``$`` stand for the ends."""
    def cut(mark: str, text: Column, n: int) -> Column:
        last = F.greatest(F.char_length(text) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    ended = {mark: F.concat(F.lit("^"), text, F.lit("$")) for mark, text in (("h", host), ("p", path))}
    return F.concat(*[cut(mark, text, n) for mark, text in ended.items() for n in widths])


def judge(pages: DataFrame, rules: list[tuple[str, str]], sample: int = 5_000, features: int = 1 << 12, cut: float = 0.5) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, blocked) of all ``pages`` (page_id, url).

    The verdict of the longest fitting rule counts. The small labelled table is made of distinct urls that rules
    judge, at most ``sample`` of them, chosen by a hash of host and path; logistic regression on hashed
    n-grams learns from it and gives ``blocked``, the probability of a block, for every url. Without a rule the verdict is
    block from ``cut`` on. If no url has a rule, or all have one verdict, urls without a rule get that verdict, allow if none.
    Null urls count as empty host and path. Repeated rows and null ids keep their rows; other columns are not read.
    """
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()], F.lit(None).cast("string"))
    labelled = (known.filter("rule is not null").select("host", "path", (by_rule == "block").cast("double").alias("label")).distinct()
                .orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    training = hashing.transform(labelled.withColumn("grams", grams(F.col("host"), F.col("path")))).select("label", "features").coalesce(4).cache()
    kinds = [r.label for r in training.select("label").distinct().collect()]
    if len(kinds) == 2:
        model = LogisticRegression(maxIter=60, regParam=1e-3, probabilityCol="p", rawPredictionCol="r", predictionCol="q").fit(training)
        scored = model.transform(hashing.transform(known.withColumn("grams", grams(F.col("host"), F.col("path")))))
        found = scored.withColumn("blocked", F.element_at(_as_array("p"), 2))
    else:
        found = known.withColumn("blocked", F.lit(kinds[0] if kinds else 0.0))
    training.unpersist()
    return found.select("page_id", "host", "path", "rule",
                        F.coalesce(by_rule, F.when(F.col("blocked") >= cut, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "blocked")


def _as_array(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)
