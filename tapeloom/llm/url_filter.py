"""URL filter: explicit rules first, a logistic regression on hashed character n-grams else.

Everything runs inside the JVM: host and path are cut out with SQL functions,
n-grams are array expressions, and hashing, fitting and scoring are pyspark.ml.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4)
BUCKETS = 4096
MAX_TRAIN = 4096  # labelled urls that a model is fitted on
BLOCK_AT = 0.5


@dataclass(frozen=True)
class Rule:
    """``host/path``: the host with its subdomains, paths that begin with the path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule], value: str = "text") -> Column:
    """Text (or verdict) of the longest rule that fits; null without one.  Equal lengths: the first in code point order."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        out = F.when(r.fits(host, path), getattr(r, value)).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked with where they come from."""

    def of(mark: str, s: Column, n: int) -> Column:
        s = F.concat(F.lit("^"), s, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1)))  # a shorter text is one gram
        return F.transform(starts, lambda i: F.concat(F.lit(mark), s.substr(i, F.lit(n))))

    return F.concat(*[of(mark, s, n) for mark, s in (("h", host), ("p", path)) for n in GRAMS])


@dataclass
class UrlModel:
    """Coefficients of a fitted model; without both labels in the table nothing is fitted and every url is allowed."""

    fitted: LogisticRegressionModel | None

    def score(self, urls: DataFrame, host: str, path: str, to: str) -> DataFrame:
        """Add the probability that a url is to be blocked."""
        if self.fitted is None:
            return urls.withColumn(to, F.lit(0.0))
        with_grams = urls.withColumn("_grams", grams(F.col(host), F.col(path)))
        scored = self.fitted.transform(_hashed(with_grams))
        return scored.withColumn(to, vector_to_array("_probability")[1]).drop("_grams", "_features", "_raw", "_probability", "_predicted")


def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True).transform(df)


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> UrlModel:
    """Fit on a small table (url, label), label 1 for block and 0 for allow.

    Distinct (host, path, label) rows count once; of more than ``max_train`` those
    with the smallest hash are used, so that reruns agree.  Null urls are texts
    without host and path, null labels are left out.
    """
    rows = labelled.where("label is not null").select(host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"), F.col("label").cast("double").alias("_label")).distinct()
    rows = rows.orderBy(F.xxhash64("_host", "_path", "_label"), "_host", "_path", "_label").limit(max_train)
    train = _hashed(rows.withColumn("_grams", grams(F.col("_host"), F.col("_path")))).select("_features", "_label").coalesce(1)
    if train.select("_label").distinct().count() < 2:
        return UrlModel(None)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_predicted", maxIter=30, regParam=0.001)
    return UrlModel(lr.fit(train))


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel) -> DataFrame:
    """Per page ``page_id``, ``url``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``p_block``.

    The longest fitting rule decides, else the model.  A null url, or one without
    ``://``, has empty host and path, fits no rule and is left to the model.  One row
    per input row, repeated rows included; other columns are not kept.
    """
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.score(parts, "host", "path", "p_block")
    ruled = longest_rule(F.col("host"), F.col("path"), rules, "verdict")
    return scored.select(
        "page_id", "url", "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce(ruled, F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"), "p_block",
    )


def labelled_by(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """A label table out of the urls that rules decide."""
    verdict = longest_rule(host_of(F.col("url")), path_of(F.col("url")), rules, "verdict")
    return pages.select("url", (verdict == "block").cast("int").alias("label")).where("label is not null")
