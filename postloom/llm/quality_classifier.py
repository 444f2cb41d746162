"""Quality scores by a sparse rule ensemble.

Trees of a small forest are grown on statistics of labelled texts; every node's path is a rule, a conjunction of bounds on
statistics. A logistic model with the lasso keeps the rules that matter, and these become one Spark column, so that scoring
is a projection. Statistics come from the text alone; labels, language, source and id are never inputs of a score.

Labels are learned from all labelled rows of the training documents, by distributed fits.

Defined results: a null text is empty; texts without words get the score of their statistics, all 0; without labels every
score is 0.5, and with one class only it is that class's smoothed share; repeated rows and null ids are scored each.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import SPACE_CLASS, cut, table

TREES, DEPTH, SEED = 20, 3, 7
LASSO = 5e-4
FOLDS, HELD_OUT = 4, 2
CUT_OFF = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; __text and __words have to be columns, as with_statistics() makes them."""
    w, n, chars = F.col("__words"), F.size("__words"), F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    per_word = lambda x: x / F.greatest(n, F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    echo = F.aggregate(F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    return {
        "words": n.cast("double"),
        "word_length": per_word(F.length(F.array_join(w, ""))),
        "distinct": per_word(F.size(F.array_distinct(w))),
        "echoes": per_word(echo),
        "symbols": share("[#*$%&<>~^=+@_\\\\]"),
        "bars": share("[|]"),
        "stops": share("[.]"),
        "commas": share("[,;:]"),
        "marks": share("[!?]"),
        "capitals": share("[A-Z]"),
        "digits": share("[0-9]"),
        "other": share("[A-Za-z0-9\\x20-\\x7E\\n]"),
        "line_words": n / F.greatest(F.size(lines), F.lit(1)),
        "line_repeats": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id and the statistics, as columns with a leading underscore."""
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text")).withColumn("__words", F.filter(F.split("__text", f"{SPACE_CLASS}+"), lambda w: w != ""))
    made = statistics(F.col("__text"))
    return out.select("doc_id", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{n}") for n, c in made.items()]), [f"_{n}" for n in made]


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most the bound, bound), all of them


def rules_of(debug_string: str) -> list[Rule]:
    """The paths to all nodes of a forest, from its printed form."""
    out: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in debug_string.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        elif m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)", line):
            path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), (int(m[2]), m[3] == "<=", float(m[4])))]
            out[tuple(sorted({p[1] for p in path}))] = None
    return [*out]


def holds(rule: Rule, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(names[i]) <= bound if below else F.col(names[i]) > bound for i, below, bound in rule])


def compiled(intercept: float, weighted: list[tuple[Rule, float]], names: list[str]) -> Column:
    """The ensemble as a column of scores between 0 and 1."""
    total = F.lit(float(intercept))
    for rule, weight in weighted:
        total = total + F.when(holds(rule, names), float(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, names: list[str]) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules with their weights; labelled: the statistics and label (0 or 1)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    counts = {int(r["label"]): r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        import math

        return (math.log((good + 1) / (bad + 1)) if good + bad else 0.0), []
    vectors = labelled.select("label", *names, array_to_vector(F.array(*names)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=SEED).fit(vectors)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return 0.0, []
    fired = cut(labelled.select("label", array_to_vector(F.array(*[holds(r, names).cast("double") for r in rules])).alias("x")))
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=80, tol=1e-5).fit(fired)
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-9]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted. labels: doc_id and quality (0 or 1)."""
    stats, names = with_statistics(docs)
    stats = cut(stats.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD_OUT))
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("double").alias("label"))
    labelled = cut(stats.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("__id")).select("label", *names))
    intercept, weighted = fit(labelled, names)
    score = compiled(intercept, weighted, names)
    return stats.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT_OFF).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
