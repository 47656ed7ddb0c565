"""Rules (paths of trees) over sparse cells: which rows meet them, their fit with linear terms, and their table.

Rows are never written out. A row of zeros meets a rule or not, and so does, by default, every row without a cell in the
rule's features; cells are joined with the conditions on their feature, and what they change is counted by row and rule.
Only rows that differ from the default are kept, so a rule that zeros meet is stored by the rows that break it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from .models import assembled, rule_paths

Rule = tuple[tuple[int, str, float], ...]
_MEETS = {"<=": lambda v, cut: v <= cut, ">": lambda v, cut: v > cut, "<": lambda v, cut: v < cut, ">=": lambda v, cut: v >= cut}


def met_by_zeros(rule: Rule) -> bool:
    return all(_MEETS[op](0.0, cut) for _, op, cut in rule)


def conditions(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule, feature, op, cut, zero: whether 0 meets it), a row for each condition: as many as rules times their depth."""
    rows = [(k, f, op, float(cut), bool(_MEETS[op](0.0, cut))) for k, r in enumerate(rules) for f, op, cut in r]
    return spark.createDataFrame(rows, "rule int, feature int, op string, cut double, zero boolean")


def exceptions(cells: DataFrame, rules: list[Rule]) -> DataFrame:
    """(pair_id, rule): where a row of cells (pair_id, feature, value) differs from a row of zeros in meeting a rule."""
    spark = cells.sparkSession
    v, cut = F.col("value"), F.col("cut")
    meets = F.when(F.col("op") == "<=", v <= cut).when(F.col("op") == ">", v > cut).when(F.col("op") == "<", v < cut).otherwise(v >= cut)
    changes = cells.join(F.broadcast(conditions(spark, rules)), "feature").select("pair_id", "rule", (meets.cast("int") - F.col("zero").cast("int")).alias("change")).where("change <> 0")
    base = spark.createDataFrame([(k, sum(_MEETS[op](0.0, cut) for _, op, cut in r), len(r)) for k, r in enumerate(rules)], "rule int, base int, n int")
    counted = changes.groupBy("pair_id", "rule").agg(F.sum("change").alias("change")).join(F.broadcast(base), "rule")
    return counted.where((F.col("base") + F.col("change") == F.col("n")) != (F.col("base") == F.col("n"))).select("pair_id", "rule")


def supports(cells: DataFrame, rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, n, support) of all rules: how many of rows (pair_id) meet them, from exceptions and the number of rows."""
    spark, total = rows.sparkSession, rows.count()
    defaults = spark.createDataFrame([(k, met_by_zeros(r)) for k, r in enumerate(rules)], "rule int, zeros boolean")
    found = exceptions(cells, rules).groupBy("rule").agg(F.count("*").alias("other"))
    other = F.coalesce("other", F.lit(0))
    n = F.when(F.col("zeros"), total - other).otherwise(other)
    return defaults.join(found, "rule", "left").select("rule", n.alias("n"), (n / float(max(1, total))).alias("support"))


@dataclass
class RuleFit:
    """A logistic model over linear terms and rules; coefficients of rules are those of meeting them."""

    width: int
    rules: list[Rule]
    linear: dict[int, float]
    weights: dict[int, float]
    intercept: float

    def text(self, k: int) -> str:
        return " & ".join(f"f{f} {op} {cut:g}" for f, op, cut in self.rules[k])


def rule_fit(cells: DataFrame, rows: DataFrame, width: int, trees: int = 25, depth: int = 2, most: int = 500, l1: float = 0.01) -> RuleFit:
    """Rules from boosted trees, then an L1 logistic model over rules and linear terms; the fit is unweighted.

    A rule that zeros meet enters as its opposite, whose indicator is sparse: the coefficient changes its sign and the
    intercept, which is not penalised, takes it up, so the optimum is the same.
    """
    rows = rows.select("pair_id", F.col("y").cast("double").alias("y"))
    model = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42).fit(assembled(cells, rows, width))
    rules: list[Rule] = list(dict.fromkeys(r for t in model.trees for r in rule_paths(t.toDebugString)))[:most]
    terms = cells.select("pair_id", F.col("feature").cast("int").alias("feature"), F.col("value").cast("double").alias("value"))
    if rules:
        terms = terms.unionByName(exceptions(cells, rules).select("pair_id", (F.col("rule") + width).alias("feature"), F.lit(1.0).alias("value")))
    found = LogisticRegression(labelCol="y", regParam=l1, elasticNetParam=1.0, maxIter=200).fit(assembled(terms, rows, width + len(rules)))
    coefs = found.coefficients.toArray().tolist()
    turned = [met_by_zeros(r) for r in rules]
    weights = {k: -c if turned[k] else c for k, c in enumerate(coefs[width:])}
    intercept = float(found.intercept) + sum(c for k, c in enumerate(coefs[width:]) if turned[k])
    return RuleFit(width, rules, {f: c for f, c in enumerate(coefs[:width]) if c}, {k: c for k, c in weights.items() if c}, intercept)


def rule_scores(fit: RuleFit, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (pair_id, ..) with score, the probability of 1, and p: sums over cells and exceptions, added to what a row of zeros gets."""
    spark = rows.sparkSession
    kept = sorted(fit.weights)
    rules = [fit.rules[k] for k in kept]
    base = fit.intercept + sum(fit.weights[k] for k in kept if met_by_zeros(fit.rules[k]))
    linear = spark.createDataFrame([(f, c) for f, c in fit.linear.items()], "feature int, coef double")
    parts = cells.join(F.broadcast(linear), "feature").select("pair_id", (F.col("value") * F.col("coef")).alias("part"))
    if rules:
        change = spark.createDataFrame([(k, -fit.weights[old] if met_by_zeros(r) else fit.weights[old]) for k, (old, r) in enumerate(zip(kept, rules, strict=True))], "rule int, part double")
        parts = parts.unionByName(exceptions(cells, rules).join(F.broadcast(change), "rule").select("pair_id", "part"))
    sums = parts.groupBy("pair_id").agg(F.sum("part").alias("__part"))
    score = 1 / (1 + F.exp(-(F.coalesce("__part", F.lit(0.0)) + base)))
    return rows.join(sums, "pair_id", "left").withColumn("score", score).drop("__part").withColumn("p", (F.col("score") > 0.5).cast("int"))


def rule_table(fit: RuleFit, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(type, rule, coef, importance, support) of non-zero terms, the most important first; importance is the coefficient times the term's deviation."""
    spark, n = rows.sparkSession, rows.count()
    kept = sorted(fit.weights)
    named = spark.createDataFrame([(k, fit.text(old), fit.weights[old]) for k, old in enumerate(kept)], "rule int, name string, coef double")
    own = cells.join(rows.select("pair_id"), "pair_id", "left_semi")
    found = supports(own, rows, [fit.rules[k] for k in kept]).join(named, "rule")
    spread = F.sqrt(F.col("support") * (1 - F.col("support")))
    table = found.select(F.lit("rule").alias("type"), F.col("name").alias("rule"), "coef", (F.abs("coef") * spread).alias("importance"), "support")
    linear = spark.createDataFrame([(f, f"f{f}", c) for f, c in fit.linear.items()], "feature int, name string, coef double")
    sums = own.join(F.broadcast(linear.select("feature")), "feature", "left_semi").groupBy("feature").agg(F.count_if(F.col("value") != 0).alias("m"), F.sum("value").alias("v"), F.sum(F.col("value") * F.col("value")).alias("vv"))
    mean = F.coalesce("v", F.lit(0.0)) / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.coalesce("vv", F.lit(0.0)) / n - mean * mean))
    terms = linear.join(sums, "feature", "left").select(F.lit("linear").alias("type"), F.col("name").alias("rule"), "coef", (F.abs("coef") * deviation).alias("importance"), (F.coalesce("m", F.lit(0)) / float(max(1, n))).alias("support"))
    return terms.unionByName(table).orderBy(F.desc("importance"), "rule")


def logistic_loss(fit: RuleFit, scored: DataFrame, l1: float, deviations: dict[str, float]) -> float:
    """The penalised loss of a fit on scored rows (y, score), for checks: mean log loss and l1 times |coefficient| times deviation."""
    y, p = F.col("y"), F.col("score")
    loss = scored.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).first()[0]
    terms = {f"f{f}": c for f, c in fit.linear.items()} | {fit.text(k): c for k, c in fit.weights.items()}
    return loss + l1 * math.fsum(abs(c) * deviations[t] for t, c in terms.items())
