"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Column expressions compute statistics of the whole text.
2. A random forest of shallow trees is fitted to the labelled rows; every node
   of its trees gives one rule, the conjunction of the splits on its path.
3. A logistic regression with an L1 penalty weighs the rules; most weights
   become zero.
4. The rules that are left compile into one Spark column expression, so
   scoring is a projection: no Python, no shuffle.

Training uses at most about ``max_rows`` labelled rows (chosen by a hash of
the id; below that number all).  That bound is also what lets the labels be
broadcast to the documents.  Inputs of a score are statistics of the text and
nothing else.

Edge cases: a null text counts as empty, and an empty text has a score like
any other; null labels and labels that no document carries are ignored, of
several labels of one id the largest holds; with no labels, or labels of one
value only, every text scores that value (1.0 with none at all); an empty
table gives an empty result; an input column of an output's name is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed

MAX_ROWS = 40_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, PENALTY, SEED = 12, 3, 128, 0.002, 3
STATISTICS = ("log_words", "word_length", "repeat_share", "upper_share", "digit_share", "pipe_share",
              "mark_share", "exclaim_share", "stop_share", "other_share", "line_words")


class Rule(NamedTuple):
    """A conjunction of (statistic, at most, threshold)."""
    conditions: tuple[tuple[str, bool, float], ...]
    weight: float

    def holds(self) -> Column:
        out = F.lit(True)
        for name, below, at in self.conditions:
            out = out & ((F.col(name) <= at) if below else (F.col(name) > at))
        return out

    def __str__(self) -> str:
        return f"{self.weight:+.3f} if " + " and ".join(f"{n} {'<=' if b else '>'} {v:.4g}" for n, b, v in self.conditions)


class RuleEnsemble(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.holds(), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns STATISTICS."""
    t, words = F.col("_text"), F.col("_words")
    out = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("_words", F.filter(F.split("_text", r"\s+", -1), lambda w: w != ""))
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    same = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b)
    stats = {
        "log_words": F.log1p(F.size(words)),
        "word_length": (F.length(t) - F.size(words)) / n,
        "repeat_share": F.size(F.filter(same, lambda x: x)) / n,
        "upper_share": _count(t, UPPER) / chars,
        "digit_share": _count(t, "0123456789") / chars,
        "pipe_share": _count(t, "|") / n,
        "mark_share": _count(t, "*#$%&@^~=+<>{}[]\\/_") / n,
        "exclaim_share": _count(t, "!?") / n,
        "stop_share": _count(t, ".,;:") / n,
        "other_share": F.length(F.translate(t, UPPER + LOWER + "0123456789 .,;:!?\n", "")) / chars,
        "line_words": n / (_count(t, "\n") + 1),
    }
    return out.withColumns({k: stats[k].cast("double") for k in STATISTICS}).drop("_text", "_words")


def _rules(node, path: tuple = ()) -> list[tuple]:
    """The paths to all nodes below the root of a fitted tree."""
    out = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        name, at = STATISTICS[node.split().featureIndex()], node.split().threshold()
        for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
            # a later split of the same kind on the same statistic replaces the earlier one
            rest = tuple(c for c in path if c[:2] != (name, below))
            out += _rules(child, (*rest, (name, below, at)))
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
          label_id: str = "doc_id", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    known = (labels.select(F.col(label_id).alias("_id"), F.col(label).cast("double").alias("_label")).dropna()
             .groupBy("_id").agg(F.max("_label").alias("_label")))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < min(1.0, max_rows / max(n, 1)) * (1 << 20))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_body")).join(F.broadcast(known), "_id")
    rows = checkpointed(with_statistics(rows, "_body").select("_label", *STATISTICS)).coalesce(8)
    seen = [r["_label"] for r in rows.select("_label").distinct().limit(3).collect()]
    if len(seen) < 2:
        return RuleEnsemble(-50.0 if seen == [0.0] else 50.0, ())

    features = rows.select("*", array_to_vector(F.array(*STATISTICS)).alias("_x"))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(features)
    paths = sorted({tuple(sorted(p)) for tree in forest.trees for p in _rules(tree._call_java("rootNode"))})
    if not paths:
        share = rows.agg(F.avg("_label")).first()[0]
        return RuleEnsemble(50.0 * (2 * share - 1), ())
    matrix = array_to_vector(F.array(*[Rule(p, 1.0).holds().cast("double") for p in paths]))
    fitted = checkpointed(rows.select("_label", matrix.alias("_x"))).coalesce(8).persist()
    lasso = LogisticRegression(featuresCol="_x", labelCol="_label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(fitted)
    fitted.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(float(lasso.intercept), tuple(Rule(p, w) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-6))


def classify(docs: DataFrame, model: RuleEnsemble, text: str = "text", score: str = "score", predicted: str = "predicted",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if score >= threshold)."""
    names = [c for c in docs.columns if c not in (score, predicted)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_body"))
    rows = with_statistics(rows, "_body").select("_row", model.score().alias("_score"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in names], F.col("_score").alias(score),
                       (F.col("_score") >= threshold).cast("int").alias(predicted))
