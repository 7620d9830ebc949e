"""URL filters: host rules first, else logistic regression on hashed character n-grams.

The model is trained from a small table of labelled urls; host and path give separate
n-grams, hashed to a fixed number of features.

Rows: a null url, or one without ``://``, has empty host and path, no rule and the model's
verdict on the empty url; repeated rows are judged alike; a score at the threshold blocks;
very long urls are judged whole, as one row of n-grams; an empty table gives no rows; other
columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.llm.common import free_name

FEATURES, NGRAMS = 1 << 16, (3, 4, 5)
RESULTS = ("host", "path", "rule", "verdict", "score")

#: Rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words of the labelled urls.
BLOCKED_WORDS = (
    "casino poker slots jackpot roulette betting gamble win adult xxx porn sex escort nude cams "
    "pills viagra cialis pharma cheap discount replica payday loans ads adserver track tracker "
    "clicks banner popup affiliate warez torrent crack keygen malware phishing spam"
).split()
ALLOWED_WORDS = (
    "news library museum school college science history health garden kitchen recipes weather "
    "sports music travel maps city council society journal archive wiki docs support research "
    "forum community market house energy water nature animals language reading letters daily "
    "the theory other weather station nation thread thing there lesson person forest interest "
    "table able possible stable parent agent student current gentle moment island england planet "
    "ring spring being north south earth truth with author father mother teacher reader action "
    "section edition question address business illness pocket picket package clinic click-clock "
    "castle cascade cashmere adult-school address-book administration trackday-history winter window"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url and label (1: block), made by one rule from the two word lists."""
    def urls(words: Sequence[str], label: int) -> list[tuple[str, int]]:
        rows = []
        for i, word in enumerate(words):
            other = words[(7 * i + 3) % len(words)]
            tops, langs = ("com", "net", "org"), ("en", "de", "fr", "es")
            for j, host in enumerate((
                word, f"www.{word}", f"{word}-{other}", f"www.{word}-{other}", f"{other}{word}", f"m.{word}-x",
                f"blog.{word}.example", f"www.{word}-{other}.example",
            )):
                top, lang = tops[(i + j) % 3], langs[(i + j // 2) % 4]
                end = ("", "/", ".html", "/index")[(i + j) % 4]
                rows.append((f"http{'s' * (i % 2)}://{host}.{top}/{lang}/{(37 * i + 11 * j) % 1000}{end}", label))
                if j % 4 == 0:
                    rows.append((f"https://www.{ALLOWED_WORDS[i % len(ALLOWED_WORDS)]}.{top}/{word}/{lang}", label))
        return rows

    return spark.createDataFrame([*urls(BLOCKED_WORDS, 1), *urls(ALLOWED_WORDS, 0)], "url string, label int")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none fits."""
    fitting: Column = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        answer = F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))
        fitting = F.when(fits, answer).otherwise(fitting)
    return fitting


def grams(host: Column, path: Column, sizes: Sequence[int] = NGRAMS) -> Column:
    """Character n-grams of host and path, marked by where they come from."""
    def of(text: Column, mark: str, n: int) -> Column:
        count = F.length(text) - n + 1
        places = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(n))))

    parts = ((F.concat(F.lit("^"), host, F.lit("$")), "h"), (F.concat(F.lit("^"), path, F.lit("$")), "p"))
    return F.concat(*[of(text, mark, n) for text, mark in parts for n in sizes])


def _featured(df: DataFrame, host: Column, path: Column, terms: str, features: str, size: int) -> DataFrame:
    hashing = HashingTF(numFeatures=size, binary=True, inputCol=terms, outputCol=features)
    return hashing.transform(df.withColumn(terms, grams(host, path)))


def train(labelled: DataFrame, features: int = FEATURES) -> LogisticRegressionModel:
    """Fit on urls and labels (1: block); the table is small and read a few dozen times."""
    url = F.col("url")
    rows = _featured(labelled.select("url", "label"), host_of(url), path_of(url), "grams", "features", features)
    rows = rows.select("features", "label").coalesce(1).cache()
    try:
        return LogisticRegression(regParam=1e-3, maxIter=60, featuresCol="features", labelCol="label").fit(rows)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str, str]] = RULES,
          threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict (the rule's, else the model's) and score (to block)."""
    pages = pages.drop(*RESULTS)
    names = [free_name(pages, n) for n in ("site", "grams", "features", "rawPrediction", "probability", "prediction")]
    site, terms, vector, raw, probability, prediction = names
    url = F.col("url")
    rows = pages.withColumn(site, F.struct(host_of(url).alias("host"), path_of(url).alias("path")))
    host, path = F.col(f"{site}.host"), F.col(f"{site}.path")
    rows = _featured(rows, host, path, terms, vector, model.numFeatures)
    rows = (
        model.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(probability)
        .setPredictionCol(prediction).transform(rows)
    )
    score = vector_to_array(F.col(probability))[1]
    rule = rule_for(host, path, rules)
    return rows.select(
        *[F.col(f"`{c}`") for c in pages.columns], host.alias("host"), path.alias("path"), rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
