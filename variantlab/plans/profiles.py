"""Queries over encodings, subsets, segments, importances, paths and files, from the tables that stand in for activations and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import token_count
from ..operators import arms as A, metrics as K, mob, models as M, sparse as V, split as S, thresholds as H
from ..sources import files
from .experiments import _SHARE, _TOKENS, _rounded, table
from .features import _ALL, _F1, _JUDGED, BOTH, VEC, WIDTH, _groups, _judged, _walk, pair_vectors, vectors

#: The prefix and the longest sequence of token positions.
PREFIX, MOST = 5, 512
CODES = 16


def _encoder(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Made-up weights (k, feature, w) and (feature, b, theta); some features fire by their bias alone."""
    k, f = F.floor(F.col("id") / CODES).cast("int"), (F.col("id") % CODES).cast("int")
    weights = spark.range(WIDTH * CODES).select(k.alias("k"), f.alias("feature"), (((k * 7 + f * 13) % 11 - 5) / 10.0).alias("w"))
    params = spark.range(CODES).select(F.col("id").cast("int").alias("feature"), ((F.col("id") % 5 - 2) / 20.0).alias("b"), ((F.col("id") % 3) / 20.0).alias("theta"))
    return weights, params


def _inputs(spark, sf_dir):
    return vectors(spark, sf_dir, None).withColumnRenamed("feature", "k")


def encoded_features(spark, sf_dir):
    return _rounded(V.encode(_inputs(spark, sf_dir), *_encoder(spark)))


def decoded_vectors(spark, sf_dir):
    """Encoded, decoded and added to half of each input; totals by component."""
    weights, params = _encoder(spark)
    f, k = F.floor(F.col("id") / WIDTH).cast("int"), (F.col("id") % WIDTH).cast("int")
    decoder = spark.range(WIDTH * CODES).select(f.alias("feature"), k.alias("k"), (((f * 5 + k * 3) % 7 - 3) / 10.0).alias("w"))
    each = spark.range(WIDTH).select(F.col("id").cast("int").alias("k"))
    bias, skip = each.select("k", ((F.col("k") % 4) / 10.0).alias("b")), each.select("k", F.col("k").alias("out"), F.lit(0.5).alias("w"))
    return _rounded(V.forward(_inputs(spark, sf_dir), weights, params, decoder, bias, skip), 5)


def content_masks(spark, sf_dir):
    """How many of a document's token positions are content, and whether none is, so that its vector falls back to zeros."""
    n = token_count(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), n.alias("length"))
    tokens = docs.select("pair_id", "length", F.explode(F.sequence(F.lit(0), F.least(F.col("length") + PREFIX + 4, F.lit(MOST)) - 1)).alias("pos"))
    kept = tokens.where(V.is_content(F.col("pos"), PREFIX, F.col("length"), MOST)).groupBy("pair_id").agg(F.count("*").alias("n_content"))
    return V.flagged_fallbacks(kept, docs).join(kept, "pair_id", "left").select("pair_id", F.coalesce("n_content", F.lit(0)).alias("n_content"), "is_fallback")


def feature_subset(spark, sf_dir):
    wanted = spark.createDataFrame([(j,) for j in (0, 3, 3, 17, 63, 99)], "feature int")
    return V.subset(vectors(spark, sf_dir), wanted).groupBy("feature").agg(F.count("*").alias("n"))


def live_features(spark, sf_dir):
    rows, numbers = V.without_dead(vectors(spark, sf_dir, 0.35))
    return rows.groupBy("feature").agg(F.count("*").alias("n")).join(numbers, "feature").select("feature", "old", "n")


def just_below_thresholds(spark, sf_dir):
    rows = pair_vectors(spark, sf_dir).where(f"feature < {WIDTH}")
    return _rounded(V.just_below(rows, H.walk_right(H.histogram(rows, 40), 2)).select("feature", "pair_id", "value", "rank"))


def row_summaries(spark, sf_dir):
    return _rounded(V.row_summary(V.row_profile(vectors(spark, sf_dir, 0.3), _groups(spark, sf_dir))))


def label_shares(spark, sf_dir):
    return _rounded(A.label_distribution(table(spark, sf_dir, "labels"), "toxic"))


def _parted(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("y"))
    return S.group_split(rows, "vec_id", 0.2)


def cluster_parts(spark, sf_dir):
    return A.cluster_sizes(_parted(spark, sf_dir))


def segment_profile(spark, sf_dir):
    """Segments of clusters 0 to 6, all other clusters in segment -1, of those with 20 training rows or more."""
    mapping = spark.createDataFrame([(c, c // 2) for c in range(7)], "cluster long, segment int")
    return _rounded(A.segment_stats(A.with_segment(_parted(spark, sf_dir), mapping, "cluster"), 20))


def _importances(spark, sf_dir):
    return pair_vectors(spark, sf_dir).groupBy("feature").agg(F.sum(F.abs("value")).alias("score"))


def importance_spaces(spark, sf_dir):
    return _rounded(V.importance_by_space(_importances(spark, sf_dir), WIDTH), 5)


def top_importances(spark, sf_dir):
    return _rounded(V.top_overall(_importances(spark, sf_dir), "score", 20), 5)


def aligned_cells(spark, sf_dir):
    """Cells by label, of vectors held against the metadata of all pairs."""
    return V.aligned(vectors(spark, sf_dir), _groups(spark, sf_dir)).groupBy("grp").agg(F.count("*").alias("n"))


def _label_models(spark, sf_dir):
    """Each label's mean vector as a model's coefficients, small ones cut to 0."""
    stats = V.column_stats(vectors(spark, sf_dir, None), _groups(spark, sf_dir))
    return stats.select(F.col("grp").alias("model"), "feature", F.when(F.abs("mean") > 0.05, F.col("mean")).otherwise(0.0).alias("coef"))


def active_union(spark, sf_dir):
    return V.active_features(_label_models(spark, sf_dir))


def coefficient_spread(spark, sf_dir):
    return _rounded(V.coefficient_spread(_label_models(spark, sf_dir)))


def metric_deltas(spark, sf_dir):
    """Metrics of the clicks' prediction less those of always choosing the first."""
    rows = _judged(spark, sf_dir)
    clicks = K.classification(rows).withColumn("model", F.lit("clicks"))
    first = K.classification(rows.withColumn("p", F.lit(1))).withColumn("model", F.lit("first"))
    return _rounded(K.deltas(clicks.unionByName(first), "first"))


def labelled_vectors(spark, sf_dir):
    labels = _groups(spark, sf_dir).withColumnRenamed("grp", "label")
    return _rounded(V.with_label(vectors(spark, sf_dir), labels, WIDTH).groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 5)


def mean_pooled(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pair_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))
    return _rounded(V.mean_pool(tokens, 5).select("pair_id", "feature", "value", "rank"))


PATH = ((0, ">", 0.05), (3, "<=", 0.1), (10, ">=", -0.05))


def path_scores(spark, sf_dir):
    """Rows that meet a path's conditions, and the path's score on every row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scales = [0.1 + 0.01 * j for j in range(WIDTH)]
    return _rounded(rows.select("vec_id", M.path_predicate(F.col("v"), PATH).alias("met"), M.path_score(F.col("v"), scales, PATH).alias("score")))


def reduction_cut(spark, sf_dir):
    """The cut of line items that lowers the squares of discounts most, by the older criterion."""
    rows = table(spark, sf_dir, "lineitem")
    z = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("feature"), F.col("l_quantity").cast("double").alias("z")), F.struct(F.lit(1).alias("feature"), F.col("l_tax").cast("double").alias("z")))).alias("c"), F.lit(1.0).alias("w"), F.col("l_discount").cast("double").alias("r"))
    found = mob.best_reduction(V.split_points(z.select("c.*", "w", "r")), rows.count(), 100, 0.0)
    return _rounded(spark.createDataFrame([found] if found else [], "gain double, feature int, cut double"), 6)


def stump_split(spark, sf_dir):
    """The feature at the root of a tree of depth 1 over binary features; the SQL searches all of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), (F.col("label") >= 5).cast("double").alias("y"), (1.0 + F.col("vec_id") % 3).alias("w"), M.array_to_vector(F.transform("embedding", lambda x: (x > 0).cast("double"))).alias("features"))
    model = M.tree(rows, 1, 1)
    return spark.createDataFrame([(d, f) for d, f, _ in M.top_splits(model.toDebugString)], "depth int, feature int")


def lasso_slopes(spark, sf_dir):
    """A weighted lasso of each of four single terms; the SQL has its closed form."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") * 1.0).alias("y"), (1.0 + F.col("vec_id") % 3).alias("w"), F.col("embedding").cast("array<double>").alias("v"))
    out = []
    for j in range(4):
        model = M.lasso(rows.select("y", "w", M.array_to_vector(F.array(F.col("v")[j])).alias("features")), 0.01)
        out.append((j, float(model.coefficients[0])))
    return _rounded(spark.createDataFrame(out, "term int, coef double"), 4)


def logistic_odds(spark, sf_dir):
    """A logistic fit without penalty of a binary term: the SQL has the log odds ratio."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") >= 5).cast("double").alias("y"), (1.0 + F.col("vec_id") % 3).alias("w"), F.col("embedding").cast("array<double>").alias("v"))
    out = []
    for j in range(3):
        model = M.logistic(rows.select("y", "w", M.array_to_vector(F.array((F.col("v")[j] > 0).cast("double"))).alias("features")), 0.0, 1e-9)
        out.append((j, float(model.coefficients[0]), float(model.intercept)))
    return _rounded(spark.createDataFrame(out, "term int, coef double, intercept double"), 3)


def text_files(spark, sf_dir):
    """Lines, names, metrics, dumps and labelled vectors that come back from files."""
    pages, path = table(spark, sf_dir, "pages").select("page_id", "html"), files.scratch(spark, "csv")
    files.write_csv(pages, path)
    names, at = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("index"), F.col("p_name").alias("description"), F.array(F.lit(0.0)).alias("long")), files.scratch(spark, "names")
    names.write.option("compression", "gzip").json(at)
    back = files.read_names(spark, at, lines=True).join(names.select(F.col("index").cast("int").alias("index"), F.col("description").alias("was")), "index").where("description = was").count()
    whole = files.scratch(spark, "names")
    files.write_text(spark, json.dumps([{"index": str(r[0]), "description": r[1]} for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]), whole)
    metrics, m = {"accuracy": 0.5, "auc": 0.75}, files.scratch(spark, "metrics")
    files.write_metrics(spark, metrics, m)
    v = files.scratch(spark, "labelled")
    files.write_vectors(vectors(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), "label"), v, 500)
    cells, labels = files.read_vectors(spark, v)
    some = files.read_shards(spark, f"{v}/vectors", ["pair_id"], first=1)
    got = [
        ("lines", files.physical_lines(spark, path)), ("names", back), ("nations", files.read_names(spark, whole).count()), ("metrics", len(files.read_metrics(spark, m))),
        ("cells", cells.count()), ("labels", labels.count()), ("shard", int(0 < some.count() <= 500 and some.columns == ["pair_id"])),
    ]
    return spark.createDataFrame(got, "kind string, n long")


QUERIES = {f.__name__: f for f in (encoded_features, decoded_vectors, content_masks, feature_subset, live_features, just_below_thresholds, row_summaries, label_shares, cluster_parts, segment_profile, importance_spaces, top_importances, aligned_cells, active_union, coefficient_spread, metric_deltas, labelled_vectors, mean_pooled, path_scores, reduction_cut, stump_split, lasso_slopes, logistic_odds, text_files)}

_CODES = f"""{_ALL}, w AS (SELECT CAST(k AS INT) AS k, CAST(f AS INT) AS feature, ((k * 7 + f * 13) % 11 - 5) / 10.0::DOUBLE AS w FROM range({WIDTH}) a(k), range({CODES}) b(f)),
e0 AS (SELECT x.pair_id, w.feature, sum(x.value * w.w) + any_value((w.feature % 5 - 2) / 20.0::DOUBLE) AS value FROM x JOIN w ON w.k = x.feature GROUP BY 1, 2), e AS (SELECT * FROM e0 WHERE value > 0 AND value > (feature % 3) / 20.0::DOUBLE)"""
_PARTED = f"d AS (SELECT vec_id, label AS cluster, embedding[1]::DOUBLE AS y, {_SHARE.format('vec_id')} >= 0.2 AS train FROM embeddings)"
_IMPORTANCE = f"{BOTH}, i AS (SELECT feature, sum(abs(value)) AS score FROM b GROUP BY 1)"
_MODELS = f"{_ALL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), mm AS (SELECT x.label AS model, feature, sum(value) / any_value(n) AS c FROM x JOIN n ON n.label = x.label WHERE value <> 0 GROUP BY 1, 2), m AS (SELECT model, feature, CASE WHEN abs(c) > 0.05 THEN c ELSE 0 END AS coef FROM mm)"


def _metrics(model: str, source: str) -> str:
    return f"SELECT '{model}' AS model, avg(CAST(y = p AS INT)) AS accuracy, sum(w * CAST(y = p AS INT)) / sum(w) AS weighted_accuracy, {_F1.format(1)} AS f1_binary, ({_F1.format(1)} + {_F1.format(0)}) / 2 AS f1_macro FROM {source}"


_GINI = "2 * (s1 / s) * (1 - s1 / s)"
ORACLE_SQL = {
    "encoded_features": f"WITH {_CODES} SELECT pair_id, feature, round(value, 6) AS value FROM e",
    "decoded_vectors": f"""WITH {_CODES}, o AS (SELECT CAST(k AS INT) AS k, CAST(f AS INT) AS feature, ((f * 5 + k * 3) % 7 - 3) / 10.0::DOUBLE AS w FROM range({WIDTH}) a(k), range({CODES}) b(f)),
r AS (SELECT e.pair_id, o.k, sum(e.value * o.w) AS s FROM e JOIN o ON o.feature = e.feature GROUP BY 1, 2), a AS (SELECT vec_id AS pair_id, CAST(k AS INT) AS k, embedding[CAST(k AS INT) + 1]::DOUBLE AS v FROM embeddings, range({WIDTH}) t(k))
SELECT a.pair_id, a.k, round(coalesce(s, 0) + (a.k % 4) / 10.0::DOUBLE + 0.5 * v, 5) AS value FROM a LEFT JOIN r ON r.pair_id = a.pair_id AND r.k = a.k""",
    "content_masks": f"WITH t AS (SELECT doc_id AS pair_id, {_TOKENS} AS v FROM documents) SELECT pair_id, CASE WHEN v + {PREFIX} <= {MOST} THEN v ELSE 0 END AS n_content, v = 0 OR v + {PREFIX} > {MOST} AS is_fallback FROM t",
    "feature_subset": f"WITH {VEC} SELECT feature, count(*) AS n FROM v WHERE feature IN (0, 3, 17, 63, 99) GROUP BY 1",
    "live_features": f"WITH {_ALL}, c AS (SELECT feature AS old, count(*) AS n FROM x WHERE value > 0.35 GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY old) - 1 AS INT) AS feature, old, n FROM c",
    "just_below_thresholds": f"""WITH {_walk(40, 60, 2)}, t AS (SELECT feature, arg_min(centre, bin) AS threshold FROM hr GROUP BY 1), u AS (SELECT c.*, count(*) OVER (PARTITION BY feature) AS n FROM c JOIN t USING (feature) WHERE value > 0 AND value < threshold)
SELECT feature, pair_id, round(value, 6) AS value, CAST(row_number() OVER (PARTITION BY feature ORDER BY u.value DESC, pair_id) AS INT) AS rank FROM u WHERE n >= 3 QUALIFY rank <= 3""",
    "row_summaries": f"WITH {_ALL}, r AS (SELECT e.vec_id, count(x.value) AS nnz, coalesce(sqrt(sum(x.value * x.value)), 0) AS norm FROM embeddings e LEFT JOIN x ON x.pair_id = e.vec_id AND x.value > 0.3 GROUP BY 1) SELECT " + ", ".join(f"round(quantile_cont({c}, {q}), 6)::DOUBLE AS {c}_{n}" for c in ("nnz", "norm") for n, q in (("least", 0.0), ("median", 0.5), ("p95", 0.95))) + ", count(*) FILTER (nnz = 0) AS zero_rows, count(*) AS n_rows FROM r",
    "label_shares": "SELECT toxic AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1",
    "cluster_parts": f"WITH {_PARTED} SELECT cluster, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test, count(*) AS n FROM d GROUP BY 1",
    "segment_profile": f"WITH {_PARTED} SELECT CAST(CASE WHEN cluster BETWEEN 0 AND 6 THEN cluster // 2 ELSE -1 END AS INT) AS segment, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test, round(avg(y) FILTER (train), 6) AS mean, round(stddev_pop(y) FILTER (train), 6) AS std FROM d GROUP BY 1 HAVING count(*) FILTER (train) >= 20",
    "importance_spaces": f"WITH {_IMPORTANCE} SELECT CASE WHEN feature >= {WIDTH} THEN 'diff' ELSE 'ctx' END AS space, count(*) AS n, round(avg(score), 5) AS mean FROM i GROUP BY 1",
    "top_importances": f"WITH {_IMPORTANCE} SELECT feature, round(score, 5) AS score FROM i ORDER BY i.score DESC, feature LIMIT 20",
    "aligned_cells": f"WITH {VEC} SELECT label AS grp, count(*) AS n FROM v GROUP BY 1",
    "active_union": f"WITH {_MODELS} SELECT DISTINCT feature FROM m WHERE coef <> 0",
    "coefficient_spread": f"WITH {_MODELS}, a AS (SELECT feature, sum(coef * coef) / (SELECT count(DISTINCT model) FROM m) - (sum(coef) / (SELECT count(DISTINCT model) FROM m)) ** 2 AS v FROM m GROUP BY 1 HAVING max(abs(coef)) > 0) SELECT feature, round(greatest(0, v), 6) AS variance FROM a ORDER BY v DESC, feature LIMIT 30",
    "metric_deltas": f"{_JUDGED}, g AS (SELECT y, 1 AS p, w FROM j), t AS ({_metrics('clicks', 'j')} UNION ALL {_metrics('first', 'g')}), l AS (UNPIVOT t ON accuracy, weighted_accuracy, f1_binary, f1_macro INTO NAME metric VALUE value) SELECT a.model, a.metric, round(a.value - b.value, 6) AS delta FROM l a JOIN l b ON a.metric = b.metric AND a.model = 'clicks' AND b.model = 'first'",
    "labelled_vectors": f"WITH {VEC}, u AS (SELECT feature, value FROM v UNION ALL SELECT {WIDTH}, label::DOUBLE FROM embeddings) SELECT feature, count(*) AS n, round(sum(value), 5) AS total FROM u GROUP BY 1",
    "mean_pooled": f"WITH {_ALL}, m AS (SELECT label AS pair_id, feature, avg(value) AS v FROM x GROUP BY 1, 2) SELECT pair_id, feature, round(v, 6) AS value, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY v DESC, feature) AS INT) AS rank FROM m QUALIFY rank <= 5",
    "path_scores": "SELECT vec_id, embedding[1]::DOUBLE > 0.05 AND embedding[4]::DOUBLE <= 0.1 AND embedding[11]::DOUBLE >= -0.05 AS met, round(embedding[1]::DOUBLE / 0.1 - embedding[4]::DOUBLE / 0.13 + embedding[11]::DOUBLE / 0.2, 6) AS score FROM embeddings",
    "reduction_cut": """WITH c AS (SELECT 0 AS feature, l_quantity::DOUBLE AS z, l_discount::DOUBLE AS r FROM lineitem UNION ALL SELECT 1, l_tax::DOUBLE, l_discount::DOUBLE FROM lineitem), e AS (SELECT feature, z, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM c GROUP BY 1, 2),
p AS (SELECT feature, (z + lead(z) OVER w) / 2 AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s, sum(q) OVER (PARTITION BY feature) AS q FROM e WINDOW w AS (PARTITION BY feature ORDER BY z))
SELECT round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / (q - s * s / n), 6) AS gain, feature, round(p.cut, 6) AS cut FROM p WHERE p.cut IS NOT NULL AND nl >= 100 AND n - nl >= 100 ORDER BY (sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / (q - s * s / n) DESC, feature, p.cut LIMIT 1""",
    "stump_split": f"""WITH {_ALL}, g AS (SELECT feature, value > 0 AS side, sum(1.0 + pair_id % 3) AS s, sum((1.0 + pair_id % 3) * CAST(label >= 5 AS INT)) AS s1 FROM x GROUP BY 1, 2), i AS (SELECT feature, sum(s * {_GINI}) AS impurity, count(*) AS sides FROM g GROUP BY 1)
SELECT 0 AS depth, feature FROM i WHERE sides = 2 ORDER BY impurity, feature LIMIT 1""",
    "lasso_slopes": """WITH d AS (SELECT CAST(j AS INT) AS term, label::DOUBLE AS y, 1.0 + vec_id % 3 AS w, embedding[CAST(j AS INT) + 1]::DOUBLE AS x FROM embeddings, range(4) t(j)), m AS (SELECT term, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx, sum(w * x * y) / sum(w) AS xy, sum(w * x * x) / sum(w) AS xx FROM d GROUP BY 1)
SELECT term, round(sign(xy - mx * my) * greatest(abs(xy - mx * my) - 0.01, 0) / (xx - mx * mx), 4) AS coef FROM m""",
    "logistic_odds": """WITH d AS (SELECT CAST(j AS INT) AS term, label >= 5 AS y, 1.0 + vec_id % 3 AS w, embedding[CAST(j AS INT) + 1] > 0 AS x FROM embeddings, range(3) t(j)), m AS (SELECT term, x, ln(sum(w) FILTER (y) / sum(w) FILTER (NOT y)) AS o FROM d GROUP BY 1, 2)
SELECT a.term, round(b.o - a.o, 3) AS coef, round(a.o, 3) AS intercept FROM m a JOIN m b ON a.term = b.term AND NOT a.x AND b.x""",
    "text_files": rf"""SELECT 'lines' AS kind, CAST(sum(1 + len(regexp_extract_all(html, '\r\n|\n|\r'))) AS BIGINT) AS n FROM pages UNION ALL SELECT 'names', count(*) FROM part UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'metrics', 2
UNION ALL (WITH {VEC} SELECT 'cells', count(*) FROM v) UNION ALL SELECT 'labels', count(*) FROM embeddings UNION ALL SELECT 'shard', 1""",
}
