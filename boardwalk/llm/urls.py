"""URL filter: written rules first, then logistic regression on hashed character n-grams.

Built-in column functions cut a URL into n-grams of its host and of its path; Spark's own hashing
and regression, which run in the JVM, give one weight for each hash value.  Training reads a small labelled table only, every URL is
then scored where it stands: no shuffle and no join, so a host of any size does no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import ascii_lower, computed, set_aside
from boardwalk.llm.registry import register, table

# The rules of the contract, as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

_CUT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _CUT, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _CUT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one.

    A rule fits its host and that host's subdomains when the path starts with the rule's path.
    Of two rules of one length the later in order of text wins.
    """
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | host.endswith("." + name)
        hit = on_host & path.startswith(slash + rest)
        fits = F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


@dataclass(frozen=True)
class Features:
    """n-gram lengths and the number of hash values."""

    lengths: tuple[int, ...] = (3, 4, 5)
    buckets: int = 4096


def _grams(letters: str, n: int, side: str) -> Column:
    whole = F.transform(
        F.col(letters),
        lambda c, i: F.concat(F.lit(side), c, *[F.coalesce(F.get(letters, i + k), F.lit("")) for k in range(1, n)]),
    )
    return F.slice(whole, 1, F.greatest(F.size(letters) - (n - 1), F.lit(1)))


def with_grams(df: DataFrame, spec: Features = Features()) -> DataFrame:
    """Add ``_grams``: the n-grams of ``^host$`` and of ``^path$``, marked by side.

    Text shorter than n gives one n-gram, the text itself; hosts and paths of any length are read
    whole, letter by letter.
    """
    letters = {
        f"_{side}": F.regexp_extract_all(F.concat(F.lit("^"), F.col(side), F.lit("$")), F.lit("(?s)."), F.lit(0))
        for side in ("host", "path")
    }
    cut = computed(df, letters)
    parts = [_grams(f"_{side}", n, f"{side}:") for side in ("host", "path") for n in spec.lengths]
    return computed(cut, {"_grams": F.array_distinct(F.concat(*parts))}).drop(*letters)


@dataclass(frozen=True)
class Model:
    """Hashing and weights; ``share`` instead where training had one label only."""

    hashing: HashingTF
    fit: LogisticRegressionModel | None
    share: float

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``block_probability`` to rows with ``_grams``, to six places so that reruns agree."""
        if self.fit is None:
            return df.withColumn("block_probability", F.lit(self.share))
        out = self.fit.transform(self.hashing.transform(df))
        p = F.round(vector_to_array("_probability")[1], 6)
        return out.withColumn("block_probability", p).drop("_hashed", "_raw", "_probability", "_prediction")


def train(
    labelled: DataFrame, url: str = "url", label: str = "block", spec: Features = Features(),
    max_rows: int = 10_000, ridge: float = 1e-3, rounds: int = 60,
) -> Model:
    """Fit on a labelled table with a boolean ``label``; rows without a label or URL are left out.

    At most ``max_rows`` distinct labelled URLs are used, those with the smallest hashes; that bound
    keeps training small at any size.  Without a row, or with one label only, the model gives that
    label's share for every URL (one half without a row).
    """
    hashing = HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=spec.buckets, binary=True)
    known = labelled.where(F.col(label).isNotNull() & F.col(url).isNotNull())
    known = known.groupBy(F.col(url).alias("url")).agg(F.max(F.col(label).cast("int")).cast("double").alias("label"))
    small = known.orderBy(F.xxhash64("url"), "url").limit(max_rows)
    cut = computed(small, {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = hashing.transform(with_grams(cut, spec)).select("label", "_hashed").persist()
    try:
        n, hits = rows.agg(F.count("*"), F.sum("label")).first()
        if not n or hits in (0, n):
            return Model(hashing, None, float(hits) / n if n else 0.5)
        fit = LogisticRegression(
            featuresCol="_hashed", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
            maxIter=rounds, regParam=ridge, standardization=False, tol=1e-8,
        ).fit(rows)
    finally:
        rows.unpersist()
    return Model(hashing, fit, float(hits) / n)


def judge(
    df: DataFrame, labelled: DataFrame | None = None, url: str = "url", rules: list[tuple[str, str]] = RULES, **options
) -> DataFrame:
    """Add host, path, rule, ``block_probability`` and verdict to every row.

    The longest fitting rule decides; without one the model does, and blocks from 0.5 on.  The model
    learns from ``labelled`` (url, block); left out, from the rows of ``df`` that a rule decides.
    Null URLs and URLs without ``://`` have an empty host and path and are judged like others.
    Existing columns with the names of the results are replaced; any other passes, whatever its name.
    """
    added = ["host", "path", "rule", "block_probability", "verdict"]
    df, names, kept = set_aside(df, added)
    given = F.col(names[url])
    ruled = computed(df, {"host": host_of(given), "path": path_of(given)})
    ruled = computed(ruled, {"_rule": rule_of(F.col("host"), F.col("path"), rules)})
    if labelled is None:
        labelled = ruled.select(given.alias("url"), (F.col("_rule.verdict") == "block").alias("block"))
    model = train(labelled, **options)
    scored = model.score(with_grams(ruled, options.get("spec", Features())))
    by_model = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.withColumns(
        {"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", by_model)}
    ).select(*kept, *added)


@register("op7_url_filter")
def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
