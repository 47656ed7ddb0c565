"""Model-based recursive partitioning: a linear model in each node, split where its scores are least stable.

The driver recurses over nodes; screening and the split statistic are DataFrame aggregates over a node's rows. Cuts
come from distinct values, so implicit zeros are one value. Rows: pair_id, y, w, x (array of model terms). Split features are
an array z of every row (Dense), or cells (pair_id, feature, value) of which only non-zero ones are read (Sparse).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .sparse import split_points

#: The constant of the critical value (sqrt(q) + c)^2 by level.
CRITICAL = {0.01: 2.8, 0.05: 2.2, 0.10: 1.9}


@dataclass
class Node:
    id: int
    depth: int
    n: int
    r2: float
    coefficients: list[float]
    intercept: float
    feature: int | None = None
    cut: float | None = None
    statistic: float | None = None
    left: "Node | None" = None
    right: "Node | None" = None
    path: list[tuple[int, str, float]] = field(default_factory=list)


def critical(q: int, level: float = 0.05) -> float:
    return (math.sqrt(q) + CRITICAL[level]) ** 2


def fit_node(rows: DataFrame, alpha: float):
    return LinearRegression(labelCol="y", weightCol="w", regParam=alpha, elasticNetParam=1.0, standardization=False).fit(rows.withColumn("features", array_to_vector("x")))


def refitted(rows: DataFrame, coefficients: list[float], most: int = 20) -> tuple[list[float], float]:
    """The unpenalised weighted least squares of the terms that a lasso kept (the largest, at most most); the others are 0.

    Its scores sum to zero in every active term, which a penalised fit's do not."""
    active = sorted((j for j, c in enumerate(coefficients) if c), key=lambda j: (-abs(coefficients[j]), j))[:most]
    terms = F.array(*[F.col("x")[j] for j in active]) if active else F.array(F.lit(0.0))
    model = LinearRegression(labelCol="y", weightCol="w", regParam=0.0, solver="normal" if active else "l-bfgs").fit(rows.withColumn("features", array_to_vector(terms)))
    out = [0.0] * len(coefficients)
    for j, c in zip(active, model.coefficients, strict=False):
        out[j] = float(c)
    return out, float(model.intercept)


def supremum_draws(spark: SparkSession, q: int, draws: int, trim: float = 0.1, grid: int = 500, seed: int = 42) -> DataFrame:
    """(draw, sup): draws of the supremum over [trim, 1 - trim] of |bridge(s)|^2 / (s (1 - s)), for q independent Brownian bridges: what the split statistic is like where there is nothing to split."""

    def run(frames):
        s = np.arange(1, grid) / grid
        inner = (s >= trim) & (s <= 1 - trim)
        for pdf in frames:
            out = []
            for draw in pdf.id:
                walk = np.cumsum(np.random.default_rng((seed, q, int(draw))).standard_normal((grid, q)), axis=0) / math.sqrt(grid)
                bridge = walk[:-1] - s[:, None] * walk[-1]
                out.append(float(((bridge[inner] ** 2).sum(axis=1) / (s * (1 - s))[inner]).max()))
            yield pd.DataFrame({"draw": pdf.id, "sup": out})

    return spark.range(draws).mapInPandas(run, "draw long, sup double")


def with_scores(rows: DataFrame, coefficients: list[float], intercept: float, most: int = 20) -> tuple[DataFrame, int]:
    """rows with psi: w times the residual times [1, active terms]; active: the largest coefficients, at most most."""
    active = sorted((j for j, c in enumerate(coefficients) if c), key=lambda j: (-abs(coefficients[j]), j))[:most]
    fitted = F.lit(intercept)
    for j, c in enumerate(coefficients):
        if c:
            fitted = fitted + F.col("x")[j] * c
    rows = rows.withColumn("r", (F.col("y") - fitted) * F.col("w"))
    return rows.withColumn("psi", F.array(F.col("r"), *[F.col("r") * F.col("x")[j] for j in active])), len(active) + 1


def _covariance(rows: DataFrame, q: int) -> np.ndarray:
    cells = [F.sum(F.col("psi")[a] * F.col("psi")[b]) for a in range(q) for b in range(a, q)]
    *flat, n = rows.agg(*cells, F.count("*")).first()
    out, at = np.zeros((q, q)), 0
    for a in range(q):
        for b in range(a, q):
            out[a, b] = out[b, a] = (flat[at] or 0.0) / n
            at += 1
    return out + 1e-8 * np.eye(q)


class Dense:
    """Split features as an array z of every row."""

    def own(self, rows: DataFrame, path: list[tuple[int, str, float]]) -> DataFrame:
        for f, op, cut in path:
            rows = rows.where(F.col("z")[f] <= cut if op == "<=" else F.col("z")[f] > cut)
        return rows

    def screened(self, rows: DataFrame, q: int, top: int) -> list[int]:
        """The features whose values covary most with the scores, by one aggregate over (feature, value, psi)."""
        each = rows.select("psi", F.posexplode("z").alias("feature", "v"))
        shares = [F.try_divide(F.pow(F.covar_pop("v", F.col("psi")[k]), F.lit(2)), F.var_pop("v") * F.var_pop(F.col("psi")[k])) for k in range(q)]
        total = F.coalesce(shares[0], F.lit(0.0))
        for s in shares[1:]:
            total = total + F.coalesce(s, F.lit(0.0))
        return [r[0] for r in each.groupBy("feature").agg(total.alias("s")).where("s > 0").orderBy(F.desc("s"), "feature").limit(top).collect()]

    def testable(self, rows: DataFrame) -> int:
        return rows.select(F.posexplode("z").alias("feature", "v")).groupBy("feature").agg(F.var_pop("v").alias("v")).where("v > 0").count()

    def by_value(self, rows: DataFrame, q: int, features: list[int]) -> DataFrame:
        """(feature, z, m, s0, s1, ..): rows and sums of scores of each value of the features."""
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("z")[f].alias("z")) for f in features])
        return rows.select("psi", F.explode(cells).alias("c")).groupBy("c.feature", "c.z").agg(F.count("*").alias("m"), *_psi_sums(q))


class Sparse:
    """Split features as cells (pair_id, feature, value); what a cell lacks is 0, and is never written out.

    Cells meet their row's scores in one join; what zeros add to a sum is the node's total less that of its cells.
    """

    def __init__(self, cells: DataFrame) -> None:
        self.cells = cells.where("value <> 0").select("pair_id", F.col("feature").cast("int").alias("feature"), F.col("value").cast("double").alias("v"))

    def own(self, rows: DataFrame, path: list[tuple[int, str, float]]) -> DataFrame:
        """The rows on a path: one join with the cells of its features, at most as many as the tree is deep."""
        if not path:
            return rows
        features = sorted({f for f, _, _ in path})
        values = self.cells.where(F.col("feature").isin(features)).groupBy("pair_id").agg(*[F.max(F.when(F.col("feature") == f, F.col("v"))).alias(f"__{f}") for f in features])
        rows = rows.join(values, "pair_id", "left")
        for f, op, cut in path:
            v = F.coalesce(F.col(f"__{f}"), F.lit(0.0))
            rows = rows.where(v <= cut if op == "<=" else v > cut)
        return rows.drop(*[f"__{f}" for f in features])

    def screened(self, rows: DataFrame, q: int, top: int) -> list[int]:
        """As Dense.screened: covariances from sums over cells, and over all rows for the means."""
        psi = [F.col("psi")[k] for k in range(q)]
        n, *totals = rows.agg(F.count("*"), *[F.sum(p) for p in psi], *[F.sum(p * p) for p in psi]).first()
        means = [t / n for t in totals[:q]]
        spreads = [t / n - m * m for t, m in zip(totals[q:], means, strict=True)]
        sums = self.cells.join(rows.select("pair_id", "psi"), "pair_id").groupBy("feature").agg(F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("vv"), *[F.sum(F.col("v") * p).alias(f"c{k}") for k, p in enumerate(psi)])
        mean = F.col("v") / n
        spread = F.col("vv") / n - mean * mean
        parts = [F.pow(F.col(f"c{k}") / n - mean * means[k], F.lit(2)) / spreads[k] for k in range(q) if spreads[k] > 1e-12]
        total = sum(parts, F.lit(0.0)) / spread
        found = sums.where(spread > 1e-12).select("feature", total.alias("s")).where("s > 1e-12")
        return [r[0] for r in found.orderBy(F.desc("s"), "feature").limit(top).collect()]

    def testable(self, rows: DataFrame) -> int:
        n = rows.count()
        sums = self.cells.join(rows.select("pair_id"), "pair_id").groupBy("feature").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        return sums.where(f"m < {n} OR low < high").count()

    def by_value(self, rows: DataFrame, q: int, features: list[int]) -> DataFrame:
        """As Dense.by_value; a feature's zeros are the rows and scores that its cells leave."""
        wanted = rows.sparkSession.createDataFrame([(f,) for f in features], "feature int")  # at most as many as are screened
        own = self.cells.join(F.broadcast(wanted), "feature", "left_semi").join(rows.select("pair_id", "psi"), "pair_id")
        present = own.groupBy("feature", F.col("v").alias("z")).agg(F.count("*").alias("m"), *_psi_sums(q))
        totals = rows.agg(F.count("*").alias("m_all"), *[c.alias(f"all{k}") for k, c in enumerate(_psi_sums(q))])
        rest = present.groupBy("feature").agg(F.sum("m").alias("m"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(q)])
        zeros = rest.join(F.broadcast(totals)).select("feature", F.lit(0.0).alias("z"), (F.col("m_all") - F.col("m")).alias("m"), *[(F.col(f"all{k}") - F.col(f"s{k}")).alias(f"s{k}") for k in range(q)])
        return present.unionByName(zeros.where("m > 0"))


def _psi_sums(q: int) -> list[Column]:
    return [F.sum(F.col("psi")[k]).alias(f"s{k}") for k in range(q)]


def best_cut(rows: DataFrame, q: int, features: list[int], n: int, least: int, space: Dense | Sparse = Dense()) -> tuple[float, int, float] | None:
    """(statistic, feature, cut) of the largest score fluctuation over all features and admissible cuts."""
    if not features:
        return None
    inverse = np.linalg.inv(_covariance(rows, q))
    each = space.by_value(rows, q, features)
    by = W.partitionBy("feature").orderBy("z")
    run, whole = by.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("feature")
    t = F.sum("m").over(run)
    cum = each.select("feature", "z", F.lead("z").over(by).alias("next"), t.alias("t"), *[(F.sum(f"s{k}").over(run) - t / n * F.sum(f"s{k}").over(whole)).alias(f"b{k}") for k in range(q)])
    form: Column = F.lit(0.0)
    for a in range(q):
        for b in range(q):
            form = form + float(inverse[a, b]) * F.col(f"b{a}") * F.col(f"b{b}")
    trim = max(int(0.1 * n), least)
    stat = (F.lit(float(n)) / (F.col("t") * (n - F.col("t"))) * form).alias("stat")
    found = cum.where(f"t >= {trim} AND t <= {n - trim} AND next IS NOT NULL").select(stat, "feature", ((F.col("z") + F.col("next")) / 2).alias("cut"))
    best = found.orderBy(F.desc("stat"), "feature", "cut").limit(1).collect()
    return (best[0]["stat"], best[0]["feature"], best[0]["cut"]) if best else None


def _grown(rows: DataFrame, alpha: float, depth: int, least: int, split, space: Dense | Sparse = Dense()) -> list[Node]:
    """Nodes, breadth first; split(own, node) gives (statistic, feature, cut) or nothing. A node's rows are kept while it is worked on."""
    nodes: list[Node] = []
    todo: list[tuple[list, Node | None, str]] = [([], None, "")]
    while todo:
        path, parent, side = todo.pop(0)
        own = space.own(rows, path).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = fit_node(own, alpha)
            node = Node(len(nodes), len(path), own.count(), float(model.summary.r2), [float(c) for c in model.coefficients], float(model.intercept), path=path)
            nodes.append(node)
            if parent:
                setattr(parent, side, node)
            found = split(own, node) if node.depth < depth and node.n >= 2 * least else None
        finally:
            own.unpersist()
        if found:
            node.statistic, node.feature, node.cut = found
            todo += [([*path, (node.feature, "<=", node.cut)], node, "left"), ([*path, (node.feature, ">", node.cut)], node, "right")]
    return nodes


def grow(rows: DataFrame, alpha: float = 0.01, depth: int = 4, least: int = 50, level: float = 0.05, top: int = 200, corrected: bool = True, space: Dense | Sparse = Dense()) -> list[Node]:
    """The tree as a list of nodes, breadth first. corrected: the level is divided by the number of features tried, as the maximum is taken over them."""

    def split(own: DataFrame, node: Node):
        scores, q = with_scores(own, node.coefficients, node.intercept)
        candidates = space.screened(scores, q, top)
        found = best_cut(scores, q, candidates, node.n, least, space)
        limit = critical(q, level)
        if corrected:  # a tail like exp(-x / 2) makes m tests cost 2 ln m
            limit += 2 * math.log(max(1, len(candidates)))
        return found if found and found[0] > limit else None

    return _grown(rows, alpha, depth, least, split, space)


def grow_simulated(rows: DataFrame, alpha: float = 0.01, depth: int = 4, least: int = 50, level: float = 0.05, top: int = 200, draws: int | None = None, space: Dense | Sparse = Dense()) -> list[Node]:
    """As grow, with scores of the refitted active terms and a simulated null: a node is split if the share of draws that
    reach its statistic, times the number of features that could be tested, is below level.

    That share cannot be told from 0 below one draw, so there must be 10 / level draws for each feature; fewer are an error.
    """
    spark, known = rows.sparkSession, {}

    def split(own: DataFrame, node: Node):
        again, intercept = refitted(own, node.coefficients)
        scores, q = with_scores(own, again, intercept)
        testable = space.testable(own)
        needed = math.ceil(10 * testable / level)
        if draws is not None and draws < needed:
            raise ValueError(f"{draws} draws cannot show a level of {level} over {testable} features; {needed} are needed")
        found = best_cut(scores, q, space.screened(scores, q, top), node.n, least, space)
        if not found:
            return None
        if (q, needed) not in known:
            known[q, needed] = supremum_draws(spark, q, draws or needed).persist(StorageLevel.MEMORY_AND_DISK)
        share = known[q, needed].agg(F.avg((F.col("sup") >= found[0]).cast("double"))).first()[0]
        return found if share * testable < level else None

    try:
        return _grown(rows, alpha, depth, least, split, space)
    finally:
        for table in known.values():
            table.unpersist()


def grow_by_reduction(rows: DataFrame, alpha: float = 0.01, depth: int = 4, least: int = 50, improvement: float = 0.005) -> list[Node]:
    """As grow, by the older criterion: the cut that lowers the weighted squares of a node's residuals most."""

    def split(own: DataFrame, node: Node):
        fitted = F.lit(node.intercept)
        for j, c in enumerate(node.coefficients):
            fitted = fitted + F.col("x")[j] * c
        cells = own.select("w", (F.col("y") - fitted).alias("r"), F.posexplode("z").alias("feature", "z"))
        return best_reduction(split_points(cells), node.n, least, improvement)

    return _grown(rows, alpha, depth, least, split)


def best_reduction(points: DataFrame, n: int, least: int, improvement: float = 0.005) -> tuple[float, int, float] | None:
    """The older criterion on split_points' running sums: the cut that lowers the weighted squares most, if by the share improvement."""
    by = W.partitionBy("feature")
    total = {c: F.max_by(f"sum_{c}", "z").over(by) for c in ("w", "wr", "wrr")}
    side = lambda w, r: F.coalesce(F.try_divide(r * r, w), F.lit(0.0))
    w, r = F.col("sum_w"), F.col("sum_wr")
    base = total["wrr"] - side(total["w"], total["wr"])
    gain = side(w, r) + side(total["w"] - w, total["wr"] - r) - side(total["w"], total["wr"])
    enough = (F.col("sum_n") >= least) & (n - F.col("sum_n") >= least)
    best = points.select("feature", "cut", F.try_divide(gain, base).alias("gain"), enough.alias("enough")).where(f"enough AND cut IS NOT NULL AND gain >= {improvement}").orderBy(F.desc("gain"), "feature", "cut").limit(1).collect()
    return (best[0]["gain"], best[0]["feature"], best[0]["cut"]) if best else None


def leaf_of(nodes: list[Node]) -> Column:
    """The id of each row's leaf, as nested conditions on z."""

    def at(node: Node) -> Column:
        if node.left is None or node.right is None:
            return F.lit(node.id)
        return F.when(F.col("z")[node.feature] <= node.cut, at(node.left)).otherwise(at(node.right))

    return at(nodes[0])


def split_table(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    """(node, feature, cut, left_node, right_node) of a tree, as routed takes it."""
    return spark.createDataFrame([(n.id, n.feature, n.cut, n.left.id if n.left else None, n.right.id if n.right else None) for n in nodes], "node int, feature int, cut double, left_node int, right_node int")


def routed(rows: DataFrame, cells: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """rows (pair_id, ..) with leaf, by cells (pair_id, feature, value) whose absent values are 0, through a tree of any kind.

    nodes: node, feature (null: a leaf), cut, left_node, right_node; the root is 0. Only cells of the tree's features are
    shuffled, once, into a map for each row; every level is a join with the nodes, of which a tree has few.
    """
    inner = nodes.where("feature IS NOT NULL").select("node", F.col("feature").alias("__f"), F.col("cut").alias("__cut"), F.col("left_node").alias("__left"), F.col("right_node").alias("__right"))
    inner = rows.sparkSession.createDataFrame(inner.collect(), inner.schema)  # as small as the tree
    own = cells.join(F.broadcast(inner.select(F.col("__f").alias("feature")).distinct()), "feature", "left_semi")
    values = own.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature").cast("int"), F.col("value").cast("double")))).alias("__values"))
    out = rows.join(values, "pair_id", "left").withColumn("leaf", F.lit(0))
    at = F.coalesce(F.try_element_at("__values", F.col("__f")), F.lit(0.0))
    for _ in range(depth):
        out = out.join(F.broadcast(inner), F.col("leaf") == inner["node"], "left")
        out = out.withColumn("leaf", F.when(F.col("__f").isNull(), F.col("leaf")).when(at <= F.col("__cut"), F.col("__left")).otherwise(F.col("__right"))).drop("node", "__f", "__cut", "__left", "__right")
    return out.drop("__values")


def predicted(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """rows with leaf and p, by each leaf's own model."""
    p = F.lit(None).cast("double")
    for node in nodes:
        if node.left is None:
            fitted = F.lit(node.intercept)
            for j, c in enumerate(node.coefficients):
                if c:
                    fitted = fitted + F.col("x")[j] * c
            p = F.when(F.col("leaf") == node.id, fitted).otherwise(p)
    return rows.withColumn("leaf", leaf_of(nodes)).withColumn("p", p)


def paths(nodes: list[Node], names: dict[int, str] | None = None) -> list[tuple[int, str]]:
    """(node, conditions) of all nodes, breadth first, features by name."""
    called = lambda f: (names or {}).get(f, f"z{f}")
    return [(n.id, " & ".join(f"{called(f)} {op} {cut:g}" for f, op, cut in n.path) or "all") for n in nodes]


def node_table(rows: DataFrame, nodes: list[Node], names: dict[int, str] | None = None) -> DataFrame:
    label = dict(paths(nodes, names))
    return rows.sparkSession.createDataFrame([(n.id, n.depth, n.n, n.r2, n.feature, n.cut, n.statistic, label[n.id]) for n in nodes], "node int, depth int, n long, r2 double, feature int, cut double, statistic double, path string")
