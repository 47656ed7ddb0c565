"""Queries over sparse features, thresholds, metrics and models, built from embeddings: a pair is two neighbouring vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics as K, mob, models as M, pairs as P, rules as R, sparse as V, thresholds as H
from ..sources import files
from .experiments import PAIRS, _rounded, arms, table

WIDTH = 64
THETA = 0.05


def vectors(spark: SparkSession, sf_dir: str, theta: float | None = THETA) -> DataFrame:
    return V.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", theta)


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 2k and 2k + 1 as a pair's sides: context below WIDTH, difference from WIDTH on."""
    rows = vectors(spark, sf_dir)
    sides = rows.select(F.floor(F.col("pair_id") / 2).alias("pair_id"), (1 - 2 * (F.col("pair_id") % 2)).alias("sign"), "feature", "value")
    return V.context_and_difference(sides, WIDTH)


def _groups(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.col("label").alias("grp"))


def sparse_vectors(spark, sf_dir):
    return _rounded(vectors(spark, sf_dir))


def context_difference(spark, sf_dir):
    return _rounded(pair_vectors(spark, sf_dir))


def mirrored_vectors(spark, sf_dir):
    rows = P.mirrored(pair_vectors(spark, sf_dir).where(f"feature >= {WIDTH}"))
    return _rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 5)


def feature_scales(spark, sf_dir):
    return _rounded(V.scale_table(vectors(spark, sf_dir), table(spark, sf_dir, "embeddings").count()))


def scale_diagnostics(spark, sf_dir):
    """Values before and after both scalings, over the sparse side of the pairs."""
    pairs = F.lit(table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2)).distinct().count())
    return _rounded(V.scale_diagnostics(pair_vectors(spark, sf_dir), pairs, 2 * WIDTH + 2), 5)


#: Two paths over differences, whose features are numbered from WIDTH.
DIFFERENCE_PATHS = [((WIDTH, "<", 0.02), (WIDTH + 3, ">=", 0.0)), ((WIDTH + 10, ">=", 0.05), (WIDTH, "<", 0.1), (WIDTH + 5, "<", 0.3))]


def path_rows(spark, sf_dir):
    """All pairs that meet a path, scored with scales of all pairs."""
    cells, rows = pair_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id")).distinct()
    return _rounded(V.path_rows(cells, rows, V.scale_table(cells, rows.count()), DIFFERENCE_PATHS))


def path_leaders(spark, sf_dir):
    """The three pairs of the highest score of each path."""
    return V.top_k(path_rows(spark, sf_dir), ["path"], "score", 3, "pair_id").select("path", "pair_id", "score", "rank")


def scaled_rows(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _rounded(V.scaled(rows, V.scale_table(rows, table(spark, sf_dir, "embeddings").count()), "largest").groupBy("pair_id").agg(F.sum("value").alias("total"), F.max("value").alias("largest")))


def row_profiles(spark, sf_dir):
    return _rounded(V.row_profile(vectors(spark, sf_dir, 0.3), _groups(spark, sf_dir)))


def sparsity(spark, sf_dir):
    return _rounded(V.sparsity(vectors(spark, sf_dir, 0.3), table(spark, sf_dir, "embeddings").count(), WIDTH))


def column_stats(spark, sf_dir):
    return _rounded(V.column_stats(vectors(spark, sf_dir), _groups(spark, sf_dir)))


def distinctive_features(spark, sf_dir):
    rows, groups = vectors(spark, sf_dir), _groups(spark, sf_dir)
    overall = V.column_stats(rows, groups.withColumn("grp", F.lit(0)))
    return _rounded(V.distinctive(V.column_stats(rows, groups), overall, 5).select("grp", "feature", "gap", "rank"))


def top_activations(spark, sf_dir):
    return _rounded(V.top_k(vectors(spark, sf_dir), ["feature"], "value", 3, "pair_id"))


def bottom_activations(spark, sf_dir):
    return _rounded(V.top_k(vectors(spark, sf_dir, None), ["feature"], "value", 3, "pair_id", ascending=True))


def top_positive_or_absolute(spark, sf_dir):
    # without the positive values of odd features, so that these reach the second branch
    rows = vectors(spark, sf_dir, None).where("feature % 2 = 0 OR value < 0")
    return _rounded(V.top_positive_or_absolute(rows, 3))


def top_positive_activations(spark, sf_dir):
    """As top_positive_or_absolute, over all values; that query's table lacks the positive values of odd features, to reach the second branch."""
    return _rounded(V.top_positive_or_absolute(vectors(spark, sf_dir, None), 3))


def split_points(spark, sf_dir):
    z = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("feature"), F.col("l_quantity").cast("double").alias("z"), F.lit(1.0).alias("w"), F.col("l_discount").cast("double").alias("r"))
    return _rounded(V.split_points(z), 4)


def max_pooled(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").select(F.col("label").alias("vec_id"), "embedding", (F.col("vec_id") % 3 != 0).alias("content"))
    rows = tokens.select("content", F.col("vec_id").alias("pair_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))
    return _rounded(V.max_pool(rows))


def histograms(spark, sf_dir):
    return H.histogram(vectors(spark, sf_dir), 20).select("feature", "bin", "n")


def walk_thresholds(spark, sf_dir):
    """Context thresholds (low null) and difference thresholds of pair vectors."""
    rows = pair_vectors(spark, sf_dir)
    right = H.walk_right(H.histogram(rows.where(f"feature < {WIDTH}"), 40), 2).select("feature", F.lit(None).cast("double").alias("low"), F.col("threshold").alias("high"))
    out = H.walk_outward(H.histogram(rows.where(f"feature >= {WIDTH}"), 60), 2)
    return _rounded(right.unionByName(out))


def published_walk_thresholds(spark, sf_dir):
    """As walk_thresholds with the published settings: 200 and 300 bins, and 4 bins that must all be higher."""
    rows = pair_vectors(spark, sf_dir)
    right = H.walk_right(H.histogram(rows.where(f"feature < {WIDTH}"), 200), 4).select("feature", F.lit(None).cast("double").alias("low"), F.col("threshold").alias("high"))
    out = H.walk_outward(H.histogram(rows.where(f"feature >= {WIDTH}"), 300), 4)
    return _rounded(right.unionByName(out))


def learned_binarised_counts(spark, sf_dir):
    """Counts of 1 and -1 by feature under the thresholds that walk_thresholds learns, implicit zeros included."""
    rows = pair_vectors(spark, sf_dir)
    right = H.walk_right(H.histogram(rows.where(f"feature < {WIDTH}"), 40), 2).select("feature", F.lit(None).cast("double").alias("low"), F.col("threshold").alias("high"))
    th = right.unionByName(H.walk_outward(H.histogram(rows.where(f"feature >= {WIDTH}"), 60), 2))
    pairs = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id")).distinct()
    return H.binarised_with_zeros(rows, th, pairs).groupBy("feature", "value").agg(F.count("*").alias("n")).withColumn("value", F.col("value").cast("int"))


def binarised_counts(spark, sf_dir):
    """Counts of 1 and -1 by feature, implicit zeros included; thresholds are fixed by feature so that some fire at zero."""
    rows = pair_vectors(spark, sf_dir)
    th = spark.range(2 * WIDTH).select(F.col("id").cast("int").alias("feature"), F.when(F.col("id") >= WIDTH, -0.1 * ((F.col("id") % 5) - 1)).alias("low"), (0.1 * ((F.col("id") % 5) - 1)).alias("high"))
    pairs = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id")).distinct()
    return H.binarised_with_zeros(rows, th, pairs).groupBy("feature", "value").agg(F.count("*").alias("n")).withColumn("value", F.col("value").cast("int"))


def quartile_thresholds(spark, sf_dir):
    rows = vectors(spark, sf_dir, None)
    return _rounded(H.elbow(rows).join(H.central_sigma(rows), "feature"))


def valley_thresholds(spark, sf_dir):
    rows = vectors(spark, sf_dir, None)
    ctx = H.valley_context(H.histogram(rows, 100)).select("feature", F.lit(None).cast("double").alias("low"), F.col("threshold").alias("high"))
    diff = H.valley_difference(H.histogram(rows, 150)).select((F.col("feature") + WIDTH).alias("feature"), "low", "high")
    return _rounded(ctx.unionByName(diff))


def _judged(spark, sf_dir):
    return P.all_pairs(arms(spark, sf_dir)).select((F.col("ctr_first") > F.col("ctr_second")).cast("int").alias("y"), (F.col("clicks_first") >= F.col("clicks_second")).cast("int").alias("p"), F.round(F.col("clicks_first") / (F.col("clicks_first") + F.col("clicks_second") + 1), 2).alias("score"), F.abs(F.col("ctr_first") - F.col("ctr_second")).alias("w"))


_JUDGED = f"WITH {PAIRS}, j AS (SELECT CAST(ctr_first > ctr_second AS INT) AS y, CAST(clicks_first >= clicks_second AS INT) AS p, round(clicks_first / (clicks_first + clicks_second + 1), 2) AS score, abs(ctr_first - ctr_second) AS w FROM pairs)"


def classification_metrics(spark, sf_dir):
    return _rounded(K.classification(_judged(spark, sf_dir)))


def classification_report(spark, sf_dir):
    return _rounded(K.report(_judged(spark, sf_dir)))


def weighted_auc(spark, sf_dir):
    return _rounded(K.weighted_auc(_judged(spark, sf_dir)))


def regression_metrics(spark, sf_dir):
    return _rounded(K.regression(_judged(spark, sf_dir).select("w", F.col("y").cast("double").alias("y"), F.col("score").alias("p"))))


def leaf_metrics(spark, sf_dir):
    rows = arms(spark, sf_dir).select(F.col("headline").alias("leaf"), F.col("ctr").alias("y"), (F.col("clicks") / 30).alias("p"))
    return _rounded(K.leaf_r2(rows))


def file_round_trips(spark, sf_dir):
    """Rows that come back from CSV, shards, importance lines and a kept artifact."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    path = files.scratch(spark, "csv")
    files.write_csv(pages, path)
    same = files.read_csv_ranges(spark, path, "page_id long, html string").join(pages.withColumnRenamed("html", "was"), "page_id").where("html = was").count()
    path = files.scratch(spark, "shards")
    rows = vectors(spark, sf_dir)
    files.write_shards(rows, path)
    path_i = files.scratch(spark, "importances")
    files.write_importances(rows.groupBy("feature").agg(F.count("*").cast("double").alias("score")), path_i)
    kept = files.scratch(spark, "kept")
    twice = [files.kept(spark, kept, "theta-05", lambda: rows.groupBy("feature").count()).count() for _ in range(2)]
    got = [("csv", same), ("shards", files.read_shards(spark, path).count()), ("importances", files.read_importances(spark, path_i).count()), ("kept", twice[1])]
    return spark.createDataFrame(got, "kind string, n long")


def _rows(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    rows = embeddings.select(F.col("vec_id").alias("pair_id"), (F.col("label") >= 5).cast("double").alias("y"), (1.0 + F.col("vec_id") % 3).alias("w"), F.col("label").alias("cluster"))
    return M.assembled(vectors(spark, sf_dir), rows, WIDTH)


def _halves(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.where("pair_id % 4 <> 0"), rows.where("pair_id % 4 = 0")


def linear_and_tree_models(spark, sf_dir):
    """Metrics of logistic, tree, boosted and stump models on held-out rows."""
    train, test = _halves(spark, sf_dir)
    path = files.scratch(spark, "train")
    train.write.parquet(path)
    train = spark.read.parquet(path)
    fits = {"logistic": M.logistic(train), "tree": M.tree(train, 4, 5), "boosted": M.boosted(train, 10, 3, columns="0.7"), "stumps": M.boosted(train, 20, 1, rate=0.3, columns="0.5", rows=0.8)}
    parts = None
    for name, model in fits.items():
        got = M.scored(model, test).withColumn("y", F.col("y").cast("int"))
        one = K.classification(got).join(K.weighted_auc(got)).withColumn("model", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def cluster_models(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    clusters = [r[0] for r in test.select((F.col("cluster") % 3).alias("c")).distinct().collect()]
    cut = lambda df: df.withColumn("cluster", F.col("cluster") % 3)
    return M.by_cluster(cut(train), cut(test), lambda t: M.tree(t, 3, 5), clusters).select("pair_id", "cluster", "p", "score")


def rule_models(spark, sf_dir):
    train, _ = _halves(spark, sf_dir)
    cells, rows = vectors(spark, sf_dir).where("pair_id % 4 <> 0"), train.select("pair_id", "y")
    return R.rule_table(R.rule_fit(cells, rows, WIDTH, trees=5, depth=2), cells, rows)


def clusters(spark, sf_dir):
    """Cluster of each row: unit rows, reduced by uncentred SVD, k-means of several starts."""
    rows, _ = M.reduced(M.normalised(_rows(spark, sf_dir).select("pair_id", "features")), 8)
    model = M.clustered(rows, 4, 2)
    return model.transform(rows).select("pair_id", F.col("prediction").alias("cluster"))


def _mob_rows(spark, sf_dir):
    """All components: the first 8 are model terms, the others split features; y has a slope that changes with one of these."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.col("embedding").cast("array<double>").alias("v"))
    x, z = F.slice("v", 1, 8), F.slice("v", 9, WIDTH - 8)
    slope = F.when(F.col("z")[2] > 0, 2.0).otherwise(-2.0)
    return e.select("pair_id", F.lit(1.0).alias("w"), x.alias("x"), z.alias("z"), "v").withColumn("y", slope * F.col("x")[0] + 0.1 * F.col("x")[1])


def partitioned_models(spark, sf_dir):
    rows = _mob_rows(spark, sf_dir)
    return mob.node_table(rows, mob.grow(rows, 1e-4, depth=2, least=30))


def lasso_coefficients(spark, sf_dir):
    rows = _mob_rows(spark, sf_dir).withColumn("features", M.array_to_vector("v"))
    model = M.lasso(rows, 0.001)
    return spark.createDataFrame([(j, float(c)) for j, c in enumerate(model.coefficients)], "term int, coef double")


_SQL = (linear_and_tree_models, cluster_models, rule_models, clusters, partitioned_models, lasso_coefficients)
QUERIES = {f.__name__: f for f in (sparse_vectors, context_difference, mirrored_vectors, feature_scales, scale_diagnostics, path_rows, path_leaders, scaled_rows, row_profiles, sparsity, column_stats, distinctive_features, top_activations, bottom_activations, top_positive_or_absolute, top_positive_activations, split_points, max_pooled, histograms, walk_thresholds, published_walk_thresholds, learned_binarised_counts, binarised_counts, quartile_thresholds, valley_thresholds, classification_metrics, classification_report, weighted_auc, regression_metrics, leaf_metrics, file_round_trips, *_SQL)}

_ALL = "x AS (SELECT vec_id AS pair_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value, label FROM embeddings)"
VEC = f"{_ALL}, v AS (SELECT pair_id, feature, value, label FROM x WHERE value > {THETA})"
BOTH = f"""{VEC}, s AS (SELECT CAST(floor(pair_id / 2) AS BIGINT) AS pair_id, feature, sum(value) / 2 AS c, sum((1 - 2 * (pair_id % 2)) * value) AS d FROM v GROUP BY 1, 2),
b AS (SELECT pair_id, feature, c AS value FROM s WHERE c <> 0 UNION ALL SELECT pair_id, feature + {WIDTH}, d FROM s WHERE d <> 0)"""


def _hist(source: str, bins: int, name: str) -> str:
    return f"""{name}_r AS (SELECT feature, min(value) AS lo0, max(value) AS hi0 FROM {source} GROUP BY 1 HAVING count(*) >= 10), {name}_s AS (SELECT feature, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, ((CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END) - (CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END)) / {bins} AS step FROM {name}_r),
{name}_c AS (SELECT feature, CAST(least(floor((value - lo) / step), {bins} - 1) AS INT) AS bin, count(*) AS n FROM {source} JOIN {name}_s USING (feature) GROUP BY 1, 2), {name} AS (SELECT g.feature, g.bin, coalesce(n, 0) AS n, lo + (g.bin + 0.5) * step AS centre FROM (SELECT feature, lo, step, CAST(unnest(range({bins})) AS INT) AS bin FROM {name}_s) g LEFT JOIN {name}_c c USING (feature, bin))"""


def _valley(name: str, reach: int) -> str:
    w = "OVER (PARTITION BY feature ORDER BY bin)"
    deep = " AND ".join(f"smooth < lag(smooth, {j}) {w} AND smooth < lead(smooth, {j}) {w}" for j in range(1, reach + 1))
    return f"{name}_m AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0 AS smooth FROM {name}), {name}_v AS (SELECT * FROM {name}_m QUALIFY {deep})"


def _walk(right: int, outward: int, ahead: int) -> str:
    """hr: bins of context features that the next ones exceed; kr: those of difference features, from the bin nearest 0 on."""
    rises = " AND ".join(f"lead(n, {j}) OVER q > n" for j in range(1, ahead + 1))
    up = lambda source: f"(SELECT *, {rises} AS up FROM {source} WINDOW q AS (PARTITION BY feature ORDER BY bin))"
    return f"""{BOTH}, c AS (SELECT * FROM b WHERE feature < {WIDTH}), d AS (SELECT * FROM b WHERE feature >= {WIDTH}), {_hist('c', right, 'h')}, {_hist('d', outward, 'k')},
hr AS (SELECT * FROM {up('h')} WHERE up), kz AS (SELECT *, first_value(bin) OVER (PARTITION BY feature ORDER BY abs(centre), bin) AS z FROM k), kr AS (SELECT * FROM {up('kz')} WHERE up AND bin >= z)"""


_WALKED = "SELECT feature, NULL::DOUBLE AS low, round(arg_min(centre, bin), 6) AS high FROM hr GROUP BY 1 UNION ALL SELECT feature, round(-arg_min(centre, bin), 6), round(arg_min(centre, bin), 6) FROM kr GROUP BY 1"

_TOP = "SELECT pair_id, feature, round(value, 6) AS value, CAST(rank AS INT) AS rank FROM ({}) WHERE rank <= 3"
_F1 = "coalesce(2.0 * count(*) FILTER (y = {0} AND p = {0}) / nullif(count(*) FILTER (y = {0}) + count(*) FILTER (p = {0}), 0), 0)"
_R2 = "1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))"

def _paths() -> str:
    """p: all pairs, sc: deviations, f: the values of the paths' features, r: rows that meet a path."""
    used = sorted({f for path in DIFFERENCE_PATHS for f, _, _ in path})
    pivot = ", ".join(f"coalesce(max(value) FILTER (feature = {f}), 0) AS v{f}" for f in used)
    scale = ", ".join(f"coalesce(nullif(max(scale) FILTER (feature = {f}), 0), 1) AS s{f}" for f in used)
    each = [f"SELECT {k} AS path, pair_id, round({' '.join(('+' if op[0] == '>' else '-') + f' v{f} / greatest(s{f}, 1e-10)' for f, op, _ in path)}, 6) AS score FROM f, sc WHERE {' AND '.join(f'v{f} {op} {cut}::DOUBLE' for f, op, cut in path)}" for k, path in enumerate(DIFFERENCE_PATHS)]
    return f"""{BOTH}, p AS (SELECT DISTINCT CAST(floor(vec_id / 2) AS BIGINT) AS pair_id FROM embeddings), n AS (SELECT count(*) AS n FROM p),
d0 AS (SELECT feature, sqrt(greatest(0, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2)) AS scale FROM b, n GROUP BY 1), sc AS (SELECT {scale} FROM d0),
f AS (SELECT p.pair_id, {pivot} FROM p LEFT JOIN b USING (pair_id) GROUP BY 1), r AS ({' UNION ALL '.join(each)})"""


ORACLE_SQL = {
    "path_rows": f"WITH {_paths()} SELECT CAST(path AS INT) AS path, pair_id, score FROM r",
    "path_leaders": f"WITH {_paths()} SELECT CAST(path AS INT) AS path, pair_id, score, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, pair_id) AS INT) AS rank FROM r QUALIFY rank <= 3",
    "scale_diagnostics": f"""WITH {BOTH}, n AS (SELECT count(DISTINCT floor(vec_id / 2)) AS n FROM embeddings), g AS (SELECT range::INT AS feature FROM range({2 * WIDTH + 2})),
c AS (SELECT g.feature, coalesce(nullif(sqrt(greatest(0, coalesce(sum(value * value), 0) / any_value(n) - (coalesce(sum(value), 0) / any_value(n)) ** 2)), 0), 1) AS scale, coalesce(max(abs(value)), 0) AS largest FROM g CROSS JOIN n LEFT JOIN b USING (feature) GROUP BY 1),
k AS (SELECT 'original' AS kind, feature, 1.0::DOUBLE AS x, NULL::DOUBLE AS scale FROM c UNION ALL SELECT 'standard', feature, scale, scale FROM c UNION ALL SELECT 'largest', feature, largest, largest FROM c),
v1 AS (SELECT kind, min(value / x) AS least, max(value / x) AS most, avg(value / x) AS mean, stddev_pop(value / x) AS std FROM b JOIN k USING (feature) GROUP BY 1),
k1 AS (SELECT kind, min(scale) AS lo, max(scale) AS hi, avg(scale) AS mean, CASE WHEN kind <> 'original' THEN count(*) FILTER (scale < 0.01) END AS small, (SELECT count(*) FROM c WHERE largest = 0) AS dead FROM k GROUP BY 1)
SELECT kind, round(least, 5) AS least, round(most, 5) AS most, round(v1.mean, 5) AS mean, round(std, 5) AS std, round(lo, 5) AS scale_least, round(hi, 5) AS scale_most, round(k1.mean, 5) AS scale_mean, small AS small_scales, dead FROM k1 LEFT JOIN v1 USING (kind)""",
    "sparse_vectors": f"WITH {VEC} SELECT pair_id, feature, round(value, 6) AS value FROM v",
    "context_difference": f"WITH {BOTH} SELECT pair_id, feature, round(value, 6) AS value FROM b",
    "mirrored_vectors": f"WITH {BOTH} SELECT CAST(l AS INT) AS label, count(*) AS n, round(sum(value * (2 * l - 1)), 5) AS total FROM b, (VALUES (0), (1)) t(l) WHERE feature >= {WIDTH} GROUP BY l",
    "feature_scales": f"WITH {VEC}, n AS (SELECT count(*) AS n FROM embeddings) SELECT feature, round(sqrt(greatest(0, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2)), 6) AS scale, round(max(abs(value)), 6) AS largest FROM v, n GROUP BY 1",
    "scaled_rows": f"WITH {VEC}, m AS (SELECT feature, max(abs(value)) AS l FROM v GROUP BY 1) SELECT pair_id, round(sum(value / l), 6) AS total, round(max(value / l), 6) AS largest FROM v JOIN m USING (feature) GROUP BY 1",
    "row_profiles": f"WITH {_ALL} SELECT e.vec_id AS pair_id, count(x.value) AS nnz, round(coalesce(sqrt(sum(x.value * x.value)), 0), 6) AS norm FROM embeddings e LEFT JOIN x ON x.pair_id = e.vec_id AND x.value > 0.3 GROUP BY 1",
    "sparsity": f"WITH {_ALL} SELECT count(*) AS nnz, round(count(*) / ((SELECT count(*) FROM embeddings) * {WIDTH}.0), 6) AS density, {WIDTH} - count(DISTINCT feature) AS dead, count(*) FILTER (value > 0) AS positive, count(*) FILTER (value < 0) AS negative, round(min(value), 6) AS least, round(max(value), 6) AS most FROM x WHERE value > 0.3",
    "column_stats": f"WITH {VEC}, g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT v.label AS grp, feature, round(sum(value) / any_value(n), 6) AS mean, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares, round(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2, 6) AS variance FROM v JOIN g ON v.label = g.label GROUP BY 1, 2",
    "distinctive_features": f"WITH {VEC}, g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), a AS (SELECT feature, sum(value) / (SELECT count(*) FROM embeddings) AS m FROM v GROUP BY 1), s AS (SELECT v.label AS grp, feature, sum(value) / any_value(n) AS m FROM v JOIN g ON v.label = g.label GROUP BY 1, 2) SELECT grp, s.feature, round(s.m - a.m, 6) AS gap, CAST(row_number() OVER (PARTITION BY grp ORDER BY s.m - a.m DESC, s.feature) AS INT) AS rank FROM s JOIN a USING (feature) QUALIFY rank <= 5",
    "top_activations": f"WITH {VEC} " + _TOP.format("SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, pair_id) AS rank FROM v"),
    "bottom_activations": f"WITH {_ALL} " + _TOP.format("SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, pair_id) AS rank FROM x WHERE value <> 0"),
    "top_positive_or_absolute": f"WITH {_ALL}, y AS (SELECT *, bool_or(value > 0) OVER (PARTITION BY feature) AS a FROM x WHERE value <> 0 AND (feature % 2 = 0 OR value < 0)) " + _TOP.format("SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(value) DESC, pair_id) AS rank FROM y WHERE value > 0 OR NOT a"),
    "top_positive_activations": f"WITH {_ALL}, y AS (SELECT *, bool_or(value > 0) OVER (PARTITION BY feature) AS a FROM x WHERE value <> 0) " + _TOP.format("SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(value) DESC, pair_id) AS rank FROM y WHERE value > 0 OR NOT a"),
    "split_points": "WITH e AS (SELECT l_linenumber AS feature, l_quantity::DOUBLE AS z, count(*)::DOUBLE AS n, count(*)::DOUBLE AS w, sum(l_discount::DOUBLE) AS wr, sum(l_discount::DOUBLE * l_discount::DOUBLE) AS wrr FROM lineitem GROUP BY 1, 2) SELECT feature, z, (z + lead(z) OVER p) / 2 AS cut, round(sum(n) OVER p, 4) AS sum_n, round(sum(w) OVER p, 4) AS sum_w, round(sum(wr) OVER p, 4) AS sum_wr, round(sum(wrr) OVER p, 4) AS sum_wrr FROM e WINDOW p AS (PARTITION BY feature ORDER BY z)",
    "max_pooled": f"WITH {_ALL} SELECT label AS pair_id, feature, round(max(value), 6) AS value FROM x WHERE pair_id % 3 <> 0 GROUP BY 1, 2 HAVING max(value) <> 0",
    "histograms": f"WITH {VEC}, {_hist('v', 20, 'h')} SELECT feature, bin, n FROM h",
    "walk_thresholds": f"WITH {_walk(40, 60, 2)} {_WALKED}",
    "published_walk_thresholds": f"WITH {_walk(200, 300, 4)} {_WALKED}",
    "learned_binarised_counts": f"""WITH {_walk(40, 60, 2)}, t AS (SELECT feature, NULL::DOUBLE AS low, arg_min(centre, bin) AS high FROM hr GROUP BY 1 UNION ALL SELECT feature, -arg_min(centre, bin), arg_min(centre, bin) FROM kr GROUP BY 1),
p AS (SELECT DISTINCT CAST(floor(vec_id / 2) AS BIGINT) AS pair_id FROM embeddings), f AS (SELECT t.feature, coalesce(b.value, 0) AS val, low, high FROM t CROSS JOIN p LEFT JOIN b ON b.feature = t.feature AND b.pair_id = p.pair_id)
SELECT feature, CASE WHEN val >= high THEN 1 ELSE -1 END AS value, count(*) AS n FROM f WHERE val >= high OR val <= low GROUP BY 1, 2""",
    "binarised_counts": f"""WITH {BOTH}, p AS (SELECT DISTINCT CAST(floor(vec_id / 2) AS BIGINT) AS pair_id FROM embeddings), t AS (SELECT CAST(range AS INT) AS feature, CASE WHEN range >= {WIDTH} THEN -0.1::DOUBLE * ((range % 5) - 1) END AS low, 0.1::DOUBLE * ((range % 5) - 1) AS high FROM range({2 * WIDTH})),
f AS (SELECT t.feature, coalesce(b.value, 0) AS val, low, high FROM t CROSS JOIN p LEFT JOIN b ON b.feature = t.feature AND b.pair_id = p.pair_id), r AS (SELECT feature, CASE WHEN val >= high THEN 1 WHEN val <= low THEN -1 ELSE 0 END AS value FROM f) SELECT feature, value, count(*) AS n FROM r WHERE value <> 0 GROUP BY 1, 2""",
    "quartile_thresholds": f"WITH {_ALL} SELECT feature, round(quantile_cont(value, 0.25), 6) AS threshold, round(-3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, 6) AS low, round(3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, 6) AS high FROM x WHERE value <> 0 GROUP BY 1",
    "valley_thresholds": f"""WITH {_ALL}, y AS (SELECT * FROM x WHERE value <> 0), {_hist('y', 100, 'h')}, {_hist('y', 150, 'k')}, {_valley('h', 8)}, {_valley('k', 10)},
e AS (SELECT feature, (min({{'s': smooth, 'b': bin, 'c': centre}}) FILTER (centre < 0)).c AS neg, (min({{'s': smooth, 'b': bin, 'c': centre}}) FILTER (centre > 0)).c AS pos FROM k_v GROUP BY 1)
SELECT feature, NULL::DOUBLE AS low, round(min({{'s': smooth, 'b': bin, 'c': centre}}).c, 6) AS high FROM h_v GROUP BY 1 UNION ALL SELECT feature + {WIDTH}, round(coalesce(neg, -pos), 6), round(coalesce(pos, -neg), 6) FROM e WHERE neg IS NOT NULL OR pos IS NOT NULL""",
    "classification_metrics": f"{_JUDGED} SELECT round(avg(CAST(y = p AS INT)), 6) AS accuracy, round(sum(w * CAST(y = p AS INT)) / sum(w), 6) AS weighted_accuracy, round({_F1.format(1)}, 6) AS f1_binary, round(({_F1.format(1)} + {_F1.format(0)}) / 2, 6) AS f1_macro FROM j",
    "classification_report": f"{_JUDGED} " + " UNION ALL ".join(f"SELECT {c} AS label, round(coalesce(count(*) FILTER (y = {c} AND p = {c}) / nullif(count(*) FILTER (p = {c}), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (y = {c} AND p = {c}) / nullif(count(*) FILTER (y = {c}), 0), 0), 6) AS recall, round({_F1.format(c)}, 6) AS f1, count(*) FILTER (y = {c}) AS support FROM j" for c in (0, 1)),
    "weighted_auc": f"{_JUDGED}, a AS (SELECT sum(CASE WHEN q.score > n.score THEN q.w * n.w WHEN q.score = n.score THEN q.w * n.w / 2 ELSE 0 END) AS hit, sum(q.w * n.w) AS total FROM j q JOIN j n ON q.y = 1 AND n.y = 0) SELECT round(hit / total, 6) AS auc FROM a",
    "regression_metrics": _JUDGED.replace("CAST(clicks_first >= clicks_second AS INT) AS p, ", "").replace("AS score", "AS p") + f" SELECT round({_R2}, 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum(w * (y - p) * (y - p)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) AS weighted_r2 FROM j",
    "leaf_metrics": f"WITH {PAIRS}, q AS (SELECT headline AS leaf, ctr AS y, clicks / 30 AS p FROM arms) SELECT leaf, count(*) AS n, round(CASE WHEN count(*) > 10 THEN {_R2} END, 6) AS r2 FROM q GROUP BY 1",
    "file_round_trips": f"WITH {VEC} SELECT 'csv' AS kind, count(*) AS n FROM pages WHERE html IS NOT NULL UNION ALL SELECT 'shards', count(*) FROM v UNION ALL SELECT 'importances', count(DISTINCT feature) FROM v UNION ALL SELECT 'kept', count(DISTINCT feature) FROM v",
}
