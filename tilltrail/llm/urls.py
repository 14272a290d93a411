"""URL filters: rules by host and path, and boosted trees on lexical features where no rule fits.

DataFrame functions throughout; the trees are Spark's own. They learn from the URLs that the rules
label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import stored

ALLOW, BLOCK = "allow", "block"
TRAINING_ROWS = 20_000
TREES = 15
DEPTH = 3
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


# The rules asked for.
RULES = (
    Rule(BLOCK, "net/"),
    Rule(ALLOW, "example.net/en/"),
    Rule(BLOCK, "example.com/de/"),
    Rule(ALLOW, "org/fr/"),
)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``host`` (ASCII letters in lower case) and ``path``; both empty for a null URL and without ``://``."""
    rest = F.expr("CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END")
    rows = pages.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)
    return rows.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path}).drop("_rest")


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; of equal length the first by text."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for rule in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        found = F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = out.when(rule.fits(host, path), found)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    counts = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    )
    parts = F.transform(F.filter(counts, lambda k: k > 0), lambda k: -(k / n) * F.log2(k / n))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def _occurrences(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


FEATURES = ["length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "fragment", "hyphens"]
SUFFIXES = {"tld": "tld_rate", "extension": "extension_rate"}


def with_features(rows: DataFrame) -> DataFrame:
    """Lexical features of URL, host and path, and the two suffixes whose statistics are learned."""
    url = F.coalesce(F.col("url"), F.lit(""))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": (digits / F.greatest(F.length(url), F.lit(1))).cast("double"),
            "entropy": _entropy(url),
            "parameters": F.when(query == "", 0.0).otherwise(_occurrences(query, "&") + 1.0),
            "fragment": url.contains("#").cast("double"),
            "hyphens": _occurrences(url, "-"),
            "tld": F.element_at(F.split("host", r"\."), -1),
            "extension": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1),
        }
    )


def _suffix_rates(labelled: DataFrame, suffix: str) -> DataFrame:
    """How often URLs with a suffix are blocked, drawn towards a half where there are few."""
    rate = (F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)
    return labelled.groupBy(suffix).agg(rate.alias(SUFFIXES[suffix]))


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """The rates come from at most ``TRAINING_ROWS`` URLs, so they have no more rows than that."""
    for suffix, rate in rates.items():
        rows = rows.join(F.broadcast(rate), suffix, "left")
        rows = rows.withColumn(SUFFIXES[suffix], F.coalesce(SUFFIXES[suffix], F.lit(0.5)))
    return rows


def _with_own_rates_withheld(sample: DataFrame) -> DataFrame:
    """Rates for the rows that trees are trained on: of the suffix among hosts of the other folds.

    With rates of all rows a row's own label would be in its features, and the suffix that a rule names would decide alone. A suffix
    that only hosts of the row's own fold have counts as unseen, as it does when pages are judged.
    """
    rows = sample.withColumn("_fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    for suffix, rate in SUFFIXES.items():
        counts = rows.groupBy(suffix, "_fold").agg(F.sum("label").alias("_blocked"), F.count(F.lit(1)).alias("_n"))
        of_suffix = Window.partitionBy(suffix)
        blocked, n = (F.sum(c).over(of_suffix) - F.col(c) for c in ("_blocked", "_n"))
        rates = counts.select(suffix, "_fold", ((blocked + 1.0) / (n + 2.0)).alias(rate))
        # At most as many rows as the sample.
        rows = rows.join(F.broadcast(rates), [suffix, "_fold"])
    return rows.drop("_fold")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` for every page.

    A rule that fits decides; elsewhere the trees do, by a ``score`` (how likely the URL is blocked)
    above a half. They are trained on at most ``training_rows`` distinct URLs that rules label, those
    with the least hashes; suffix rates of a row come from hosts of other folds. If these carry one label only, that is the verdict, and without any it is
    ``allow``; the score is then null. Repeated pages are judged each, columns named like the new
    ones give way.
    """
    known = with_host_and_path(pages.select("page_id", "url"))
    ruled = known.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    label = (F.col("_fit.verdict") == BLOCK).cast("double").alias("label")
    labelled = ruled.filter("_fit IS NOT NULL").select("url", "host", "path", label)
    sample = with_features(labelled.distinct().orderBy(F.xxhash64("url"), "url").limit(training_rows))
    sample = stored(sample, "labelled-urls")
    labels = [r["label"] for r in sample.select("label").distinct().collect()]
    featured = with_features(ruled)
    if len(labels) < 2:
        fallback = F.lit(BLOCK if labels == [1.0] else ALLOW)
        scored = featured.withColumns({"score": F.lit(None).cast("double"), "_guess": fallback})
    else:
        rates = {suffix: stored(_suffix_rates(sample, suffix), f"{suffix}-rates") for suffix in SUFFIXES}
        vectors = VectorAssembler(inputCols=[*FEATURES, *SUFFIXES.values()], outputCol="features")
        trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=42)
        model = trees.fit(vectors.transform(_with_own_rates_withheld(sample)))
        scored = model.transform(vectors.transform(_with_rates(featured, rates)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
        scored = scored.withColumn("_guess", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", "_guess").alias("verdict"),
        "score",
    )
