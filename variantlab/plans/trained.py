"""The published path as queries: thresholds from training pairs, all pairs binarised by them, boosted trees, importances written and read back, rules on the features that the trees use; models of clusters beside the global one; segments of residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import boosting as B, metrics as K, mob, models as M, rules as R, sparse as V, split as S, thresholds as H
from ..sources import files
from .experiments import _rounded, table
from .features import _F1, BOTH, WIDTH, _walk, pair_vectors, vectors

BINS, AHEAD = (200, 300), 4
SETTINGS = B.Settings(trees=40, depth=6, rate=0.1, columns=0.7)
FIRST = B.Settings(trees=1, depth=3, rate=0.1, columns=0.7)
#: Models of clusters and the global one beside them, and the first tree of each.
EACH, FIRST_EACH = B.Settings(trees=40, depth=6, rate=0.1), B.Settings(trees=1, depth=2, rate=0.1)
#: Regression trees of segments and within them: the least weight of a leaf stands for a number of rows.
SEGMENTS = B.Settings(trees=1, depth=4, rate=1.0, l2=0.0, child=200.0, squared=True)
WITHIN = B.Settings(trees=1, depth=3, rate=1.0, l2=0.0, child=50.0, squared=True)
BAND = 16


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, y, w, part): whether the first side has the larger label, one more than the gap as weight, a fifth of the pairs for tests."""
    sides = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), ((1 - 2 * (F.col("vec_id") % 2)) * F.coalesce("label", F.lit(0))).alias("d"))
    pairs = sides.groupBy("pair_id").agg(F.sum("d").alias("d")).select("pair_id", (F.col("d") > 0).cast("int").alias("y"), (1.0 + F.abs("d")).alias("w"))
    return S.group_split(pairs, "pair_id", 0.2)


def learned(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(feature, low, high) from the cells of training rows, with the published bins."""
    train = cells.join(rows.where("part = 'train'").select("pair_id"), "pair_id", "left_semi")
    right = H.walk_right(H.histogram(train.where(f"feature < {WIDTH}"), BINS[0]), AHEAD).select("feature", F.lit(None).cast("double").alias("low"), F.col("threshold").alias("high"))
    return right.unionByName(H.walk_outward(H.histogram(train.where(f"feature >= {WIDTH}"), BINS[1]), AHEAD))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read from there."""
    spark = df.sparkSession
    path = files.scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair vectors and judged rows, both kept since thresholds and cells read them several times, and binarised cells."""
    cells, rows = _kept(pair_vectors(spark, sf_dir), "vectors"), _kept(judged(spark, sf_dir), "judged")
    return cells, H.binarised_with_zeros(cells, learned(cells, rows), rows.select("pair_id")), rows


def _binarised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _prepared(spark, sf_dir)[1:]


def _of(cells: DataFrame, rows: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    own = rows.where(F.col("part") == part)
    return cells.join(own.select("pair_id"), "pair_id", "left_semi"), own


def train_thresholds(spark, sf_dir):
    """Thresholds that training pairs give."""
    return _rounded(learned(pair_vectors(spark, sf_dir), judged(spark, sf_dir)))


def train_binarised_counts(spark, sf_dir):
    """Counts of 1 and -1 by part and feature, all pairs by the training pairs' thresholds."""
    cells, rows = _binarised(spark, sf_dir)
    return cells.join(rows.select("pair_id", "part"), "pair_id").groupBy("part", "feature", F.col("value").cast("int").alias("value")).agg(F.count("*").alias("n"))


def first_boosted_tree(spark, sf_dir):
    """The nodes of the first tree of depth 3 over binarised training pairs."""
    cells, rows = _of(*_binarised(spark, sf_dir), "train")
    return _rounded(B.node_table(spark, B.boost(cells, rows, 2 * WIDTH, FIRST)).drop("tree"))


def boosted_path(spark, sf_dir):
    """(model, n_terms, test metrics) of 40 trees on binarised pairs, and of rules and linear terms on the features that the trees use, by the importances they wrote."""
    binarised, rows = _binarised(spark, sf_dir)
    binarised = _kept(binarised, "binarised")
    (cells, train), (other, test) = _of(binarised, rows, "train"), _of(binarised, rows, "test")
    model = B.boost(cells, train, 2 * WIDTH, SETTINGS)
    path = files.scratch(spark, "importances")
    files.write_importances(B.importances(B.node_table(spark, model)).select("feature", "score"), path)
    used = files.read_importances(spark, path).select("feature")
    fit = R.rule_fit(V.subset(cells, used), train, 2 * WIDTH)
    parts = []
    for name, n, scored in (("boosted", len(model.used()), B.predicted(model, other, test)), ("rules", len(fit.linear) + len(fit.weights), R.rule_scores(fit, V.subset(other, used), test))):
        parts.append(K.classification(scored).join(K.weighted_auc(scored)).select(F.lit(name).alias("model"), F.lit(n).alias("n_terms"), "*"))
    return parts[0].unionByName(parts[1])


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Binarised differences, and judged rows with cluster: the band of the pair's strongest context feature, -1 without one."""
    vectors, binarised, rows = _prepared(spark, sf_dir)
    strongest = vectors.where(f"feature < {WIDTH}").groupBy("pair_id").agg(F.max(F.struct("value", (-F.col("feature")).alias("f"))).alias("top"))
    cluster = F.coalesce(F.floor(-F.col("top.f") / BAND).cast("int"), F.lit(-1))
    rows = rows.join(strongest, "pair_id", "left").select(*rows.columns, cluster.alias("cluster"))
    return _kept(binarised.where(f"feature >= {WIDTH}"), "differences"), _kept(rows, "clustered")


def cluster_first_trees(spark, sf_dir):
    """The first tree of each cluster's model, all grown together; clusters of one class have none."""
    cells, rows = _of(*_clustered(spark, sf_dir), "train")
    return _rounded(B.group_nodes(spark, B.boost_each(cells, rows, 2 * WIDTH, "cluster", FIRST_EACH), "int").drop("tree").withColumnRenamed("grp", "cluster"))


def _compared(test: DataFrame, train: DataFrame, each: DataFrame, whole: DataFrame) -> DataFrame:
    """(model, n_train, n_test, metrics on test rows) of the global model, of each cluster's, and of all clusters' together."""
    scored = [(F.lit("global"), whole), (F.concat(F.lit("cluster "), F.col("cluster")), each), (F.lit("combined"), each)]
    rows = None
    for name, found in scored:
        part = found.select(name.alias("model"), "y", "p", "score", "w")
        rows = part if rows is None else rows.unionByName(part)
    sizes = train.groupBy(F.concat(F.lit("cluster "), F.col("cluster")).alias("model")).agg(F.count("*").alias("n_train"))
    total = train.agg(F.count("*").alias("n_train"))
    sizes = sizes.unionByName(total.select(F.explode(F.array(F.lit("global"), F.lit("combined"))).alias("model"), "n_train"))
    return K.classification_by(rows, "model").withColumnRenamed("n", "n_test").join(sizes, "model", "left").na.fill(0, ["n_train"])


def cluster_comparison(spark, sf_dir):
    """Metrics of the global model, of each cluster's own, and of every test pair by its cluster's model."""
    cells, rows = _clustered(spark, sf_dir)
    (inside, train), (other, test) = _of(cells, rows, "train"), _of(cells, rows, "test")
    whole, each = B.boost_both(inside, train, 2 * WIDTH, "cluster", EACH)
    return _compared(test, train, B.predicted_each(each, other, test, "cluster"), B.predicted(whole, other, test))


def constant_comparison(spark, sf_dir):
    """As cluster_comparison, of models that know no features: the likelier class of all, and of each cluster."""
    _, rows = _clustered(spark, sf_dir)
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    likelier = (F.avg("y") > 0.5).cast("int").alias("p")
    own = train.groupBy("cluster").agg(likelier, F.avg("y").alias("score"))
    each = test.join(own, "cluster", "left").na.fill(0, ["p", "score"])
    whole = test.join(F.broadcast(train.agg(likelier, F.avg("y").alias("score"))))  # one row
    return _rounded(_compared(test, train, each, whole))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged rows whose y is the signed gap of the labels."""
    rows = judged(spark, sf_dir)
    return rows.withColumn("y", (F.col("w") - 1) * (2 * F.col("y") - 1))


def _side(cells: DataFrame, context: bool) -> DataFrame:
    return cells.where(f"feature {'<' if context else '>='} {WIDTH}")


def regression_tree(spark, sf_dir):
    """The tree of the gaps on binarised contexts of training pairs: the segments where the global effect is a mean."""
    cells, _ = _binarised(spark, sf_dir)
    inside, train = _of(_side(cells, True), _gaps(spark, sf_dir), "train")
    return _rounded(B.node_table(spark, B.boost(inside, train, WIDTH, SEGMENTS)).drop("tree"))


def residual_segments(spark, sf_dir):
    """(segment, n_train, n_test, mean_residual, mean and r2 of both parts): contexts that differ in what a lasso on scaled differences leaves, and
    a tree of the gap on binarised differences within each; r2 is null for parts of 10 rows or fewer."""
    binarised, rows = _kept(_binarised(spark, sf_dir)[0], "segments"), _gaps(spark, sf_dir)
    path = files.scratch(spark, "residuals")
    differences = _side(pair_vectors(spark, sf_dir), False).withColumn("feature", F.col("feature") - WIDTH)
    own = rows.where("part = 'train'")
    scales = V.scale_table(differences.join(own.select("pair_id"), "pair_id", "left_semi"), own.count())
    scaled = M.assembled(V.scaled(differences, scales), rows, WIDTH)
    M.lasso(scaled.where("part = 'train'"), 0.01).transform(scaled).select(*rows.columns, (F.col("y") - F.col("prediction")).alias("residual")).write.parquet(path)
    rows = spark.read.parquet(path)
    context, inside = _side(binarised, True), _side(binarised, False)
    train = rows.where("part = 'train'")
    tree = B.boost(context.join(train.select("pair_id"), "pair_id", "left_semi"), train.withColumn("y", F.col("residual")), WIDTH, SEGMENTS)
    segments = B.leaf_of(tree, context, rows).withColumnRenamed("leaf", "segment")
    train = segments.where("part = 'train'")
    within = B.boost_each(inside.join(train.select("pair_id"), "pair_id", "left_semi"), train, 2 * WIDTH, "segment", WITHIN)
    return _rounded(segment_fits(B.predicted_each(within, inside, segments, "segment")), 5)


def segment_fits(scored: DataFrame, least: int = 10) -> DataFrame:
    """(segment, n_train, n_test, mean_residual, train_r2, test_r2) of rows (segment, part, y, p, residual)."""
    out = []
    for part in ("train", "test"):
        own = F.col("part") == part
        y, e, n = F.when(own, F.col("y")), F.when(own, F.col("y") - F.col("p")), F.count_if(own)
        out += [n.alias(f"n_{part}"), F.when(n > least, 1 - F.try_divide(F.sum(e * e), F.var_pop(y) * n)).alias(f"{part}_r2")]
    return scored.groupBy("segment").agg(*out, F.avg(F.when(F.col("part") == "train", F.col("residual"))).alias("mean_residual"))


def rule_supports(spark, sf_dir):
    """How many pairs meet each feature's rule: at or above its learned threshold in the context, and not greater on the first side."""
    cells, rows = pair_vectors(spark, sf_dir), judged(spark, sf_dir)
    high = learned(cells, rows).where(f"feature < {WIDTH}").orderBy("feature").collect()  # a row for each feature
    rules = [((r.feature, ">=", r.high), (r.feature + WIDTH, "<=", 0.0)) for r in high]
    names = spark.createDataFrame([(k, r[0][0]) for k, r in enumerate(rules)], "rule int, feature int")
    return _rounded(R.supports(cells, rows, rules).join(names, "rule").select("feature", "n", "support"))


def simulated_partitions(spark, sf_dir):
    """The tree that refitted scores and a simulated null give over sparse cells; y has a slope that changes at two levels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.col("embedding").cast("array<double>").alias("v"))
    at = lambda k: F.get("v", F.lit(k))
    slope = F.when(at(10) > 0, F.when(at(13) > 0, 4.0).otherwise(1.0)).otherwise(-2.0)
    rows = e.select("pair_id", F.lit(1.0).alias("w"), F.slice("v", 1, 8).alias("x"), (slope * at(0) + 0.1 * at(1)).alias("y"))
    cells = vectors(spark, sf_dir, None).where("feature >= 8")
    return mob.node_table(rows, mob.grow_simulated(rows, 1e-4, depth=2, least=30, space=mob.Sparse(cells)))


def mixture_thresholds(spark, sf_dir):
    """Two components of each feature's non-zero values, and the threshold between them."""
    return _rounded(H.mixture_fits(vectors(spark, sf_dir, None)))


QUERIES = {f.__name__: f for f in (mixture_thresholds, train_thresholds, train_binarised_counts, first_boosted_tree, boosted_path, cluster_first_trees, cluster_comparison, constant_comparison, regression_tree, residual_segments, rule_supports, simulated_partitions)}

_PAIRS = """j AS MATERIALIZED (SELECT pair_id, CAST(d > 0 AS INT) AS y, 1.0::DOUBLE + abs(d) AS w, CASE WHEN ('0x' || substr(md5('42|' || pair_id), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS part
FROM (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS pair_id, sum((1 - 2 * (vec_id % 2)) * coalesce(label, 0)) AS d FROM embeddings GROUP BY 1))"""
_LEARNED = "WITH " + _walk(*BINS, AHEAD).replace(", c AS (", f", {_PAIRS}, c AS (", 1).replace("FROM b WHERE feature", "FROM b JOIN j USING (pair_id) WHERE part = 'train' AND feature")
_LEARNED += ", t AS MATERIALIZED (SELECT feature, NULL::DOUBLE AS low, arg_min(centre, bin) AS high FROM hr GROUP BY 1 UNION ALL SELECT feature, -arg_min(centre, bin), arg_min(centre, bin) FROM kr GROUP BY 1)"
_CELLS = _LEARNED + """, f AS (SELECT t.feature, j.pair_id, j.part, coalesce(b.value, 0) AS val, low, high FROM t CROSS JOIN j LEFT JOIN b ON b.feature = t.feature AND b.pair_id = j.pair_id),
z AS MATERIALIZED (SELECT pair_id, part, feature, CASE WHEN val >= high THEN 1 ELSE -1 END AS value FROM f WHERE val >= high OR val <= low)"""


_STRONGEST = f"SELECT pair_id, arg_max(CAST(floor(feature / {BAND}) AS INT), (value, -feature)) AS cluster FROM b WHERE feature < {WIDTH} GROUP BY 1"
_CLUSTERS = f"q AS MATERIALIZED (SELECT j.*, coalesce(e.cluster, -1) AS cluster FROM j LEFT JOIN ({_STRONGEST}) e USING (pair_id))"


def _tree_sql(settings: B.Settings, features: str = "true", each: bool = False, signed: bool = True) -> str:
    """The first tree over the features of a condition, whose values are 1 and, if signed, -1, or one for each cluster of both classes. Level by level: sums of a node (s) and of its features' values (v), all cuts with absent values on either side (c), the best (m), rows in children (n)."""
    unit = 1 << B.SCALE_BITS
    score = lambda g, h: f"(({g}) / {unit}.0::DOUBLE) * (({g}) / {unit}.0::DOUBLE) / (({h}) / {unit}.0::DOUBLE + {settings.l2}::DOUBLE)"
    least = round(settings.child * unit)
    drawn = f"('0x' || substr(md5('{settings.seed}:0:' || feature), 1, 8))::UBIGINT < {round(settings.columns * (1 << 32))}"
    g, h = ("(1 - w) * (2 * y - 1) * w", "w") if settings.squared else ("(0.5 - y) * w", "0.25 * w")
    out = [_CELLS, f"r AS MATERIALIZED (SELECT pair_id, CAST({g} * {unit} AS BIGINT) AS g, CAST({h} * {unit} AS BIGINT) AS h FROM j WHERE part = 'train')", "n0 AS (SELECT pair_id, 0 AS node FROM r)"]
    base, ends, tail = "1", [], ""
    if each:
        roots = "roots AS MATERIALIZED (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS node FROM q WHERE part = 'train' GROUP BY 1 HAVING min(y) < max(y))"
        out[2:] = [_CLUSTERS, roots, "n0 AS (SELECT pair_id, node FROM q JOIN roots USING (cluster) WHERE part = 'train')"]
        base, tail = "(SELECT count(*) FROM roots)", ", CAST(cluster AS INT) AS cluster"
    for k in range(settings.depth + 1):
        out.append(f"s{k} AS MATERIALIZED (SELECT node, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM n{k} JOIN r USING (pair_id) GROUP BY 1)")
        if k == settings.depth:
            ends.append(f"SELECT node, NULL AS feature, NULL AS cut, NULL AS absent_left, NULL AS left_node, NULL AS right_node, NULL AS gain, g, h FROM s{k}")
            break
        sums = ", ".join(f"coalesce(sum({x}) FILTER (value = {v}), 0)::BIGINT AS {x}{'m' if v < 0 else 'p'}" for v in (-1, 1) for x in "gh")
        out.append(f"v{k} AS (SELECT node, feature, {sums} FROM n{k} JOIN z USING (pair_id) JOIN r USING (pair_id) WHERE {drawn} AND {features} GROUP BY 1, 2)")
        both = f"SELECT node, feature, -1 AS cut, true AS absent_left, g - gp AS lg, h - hp AS lh, g, h FROM v{k} JOIN s{k} USING (node) UNION ALL SELECT node, feature, -1, false, gm, hm, g, h FROM v{k} JOIN s{k} USING (node) UNION ALL " if signed else ""
        out.append(f"""c{k} AS (SELECT node, feature, cut, absent_left, lg, lh, g, h, ({score('lg', 'lh')} + {score('g - lg', 'h - lh')} - {score('g', 'h')}) / 2 AS gain FROM ({both}SELECT node, feature, 1 AS cut, false AS absent_left, gm + gp AS lg, hm + hp AS lh, g, h FROM v{k} JOIN s{k} USING (node) WHERE gp <> 0 OR hp <> 0) WHERE lh >= {least} AND h - lh >= {least})""")
        out.append(f"m{k} AS MATERIALIZED (SELECT *, {base} + 2 * (row_number() OVER (ORDER BY node) - 1) AS left_node FROM (SELECT * FROM c{k} WHERE gain > {B.LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, cut, absent_left DESC) = 1))")
        out.append(f"n{k + 1} AS MATERIALIZED (SELECT n.pair_id, CASE WHEN CASE WHEN z.value IS NULL THEN absent_left ELSE z.value <= cut END THEN left_node ELSE left_node + 1 END AS node FROM n{k} n JOIN m{k} m USING (node) LEFT JOIN z ON z.pair_id = n.pair_id AND z.feature = m.feature)")
        ends.append(f"SELECT s.node, feature, cut, absent_left, left_node, left_node + 1, gain, s.g, s.h FROM s{k} s LEFT JOIN m{k} m USING (node)")
        base = f"{base} + 2 * (SELECT count(*) FROM m{k})"
    g, h = f"g / {unit}.0::DOUBLE", f"h / {unit}.0::DOUBLE"
    if each:
        ends = [f"SELECT o.*, cluster FROM ({end}) o JOIN (SELECT DISTINCT node, cluster FROM n{k} JOIN q USING (pair_id)) USING (node)" for k, end in enumerate(ends)]
    tail = f"SELECT CAST(node AS INT) AS node, CAST(feature AS INT) AS feature, cut::DOUBLE AS cut, absent_left, CAST(left_node AS INT) AS left_node, CAST(right_node AS INT) AS right_node, round(gain, 6) AS gain, round({h}, 6) AS hessian, round(-({g}) / ({h} + {settings.l2}) * {settings.rate}, 6) AS value{tail}"
    return ", ".join(out) + f" {tail} FROM ({' UNION ALL '.join(reversed(ends))})"


ORACLE_SQL = {
    "train_thresholds": f"{_LEARNED} SELECT feature, round(low, 6) AS low, round(high, 6) AS high FROM t",
    "train_binarised_counts": f"{_CELLS} SELECT part, feature, value, count(*) AS n FROM z GROUP BY ALL",
    "first_boosted_tree": _tree_sql(FIRST),
    "cluster_first_trees": _tree_sql(FIRST_EACH, f"feature >= {WIDTH}", each=True),
    "regression_tree": _tree_sql(SEGMENTS, f"feature < {WIDTH}", signed=False),
    "constant_comparison": f"""WITH {BOTH}, {_PAIRS}, {_CLUSTERS}, o AS (SELECT cluster, count(*) AS n, CAST(avg(y) > 0.5 AS INT) AS op, avg(y) AS os FROM q WHERE part = 'train' GROUP BY 1),
t AS (SELECT 'global' AS model, y, w, p, score FROM q, (SELECT CAST(avg(y) > 0.5 AS INT) AS p, avg(y) AS score FROM q WHERE part = 'train') WHERE part = 'test'
UNION ALL SELECT unnest(['combined', 'cluster ' || q.cluster]), y, w, coalesce(op, 0), coalesce(os, 0) FROM q LEFT JOIN o USING (cluster) WHERE part = 'test'),
a AS (SELECT t.model, sum(t.w * u.w * CASE WHEN t.score > u.score THEN 1 WHEN t.score = u.score THEN 0.5 ELSE 0 END) / sum(t.w * u.w) AS auc FROM t JOIN t u ON u.model = t.model AND t.y = 1 AND u.y = 0 GROUP BY 1)
SELECT t.model, count(*) AS n_test, round(avg(CAST(y = p AS INT)), 6) AS accuracy, round(sum(w * CAST(y = p AS INT)) / sum(w), 6) AS weighted_accuracy, round({_F1.format(1)}, 6) AS f1_binary, round(({_F1.format(1)} + {_F1.format(0)}) / 2, 6) AS f1_macro, round(any_value(auc), 6) AS auc,
CAST(coalesce(any_value(CASE WHEN t.model IN ('global', 'combined') THEN (SELECT sum(n) FROM o) ELSE o.n END), 0) AS BIGINT) AS n_train FROM t LEFT JOIN a USING (model) LEFT JOIN o ON t.model = 'cluster ' || o.cluster GROUP BY 1""",
    "rule_supports": f"{_LEARNED} SELECT t.feature, count(*) FILTER (coalesce(x.value, 0) >= t.high AND coalesce(y.value, 0) <= 0) AS n, round(count(*) FILTER (coalesce(x.value, 0) >= t.high AND coalesce(y.value, 0) <= 0) / count(*), 6) AS support FROM t CROSS JOIN j LEFT JOIN b x ON x.pair_id = j.pair_id AND x.feature = t.feature LEFT JOIN b y ON y.pair_id = j.pair_id AND y.feature = t.feature + {WIDTH} WHERE t.feature < {WIDTH} GROUP BY 1",
}
