"""Queries over arms and pairs, built from events: a test is a user, an arm an event type, a click a value above 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..functions.names import dashboard_url, missing_names, named
from ..functions.rates import rate
from ..operators import arms as A, pairs as P, split as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    grouped = events.groupBy(F.col("user_id").alias("test_id"), F.col("event_type").alias("headline")).agg(F.count("*").alias("impressions"), F.count_if(F.col("value") > 50).alias("clicks"))
    rows = grouped.withColumn("row_ord", F.col("headline")).withColumn("ctr", rate(F.col("clicks"), F.col("impressions")))
    return rows.withColumn("best", A.best_flag("test_id", "ctr")).withColumn("local_idx", A.local_index("test_id"))


ARMS = """grouped AS (SELECT user_id AS test_id, event_type AS headline, count(*) AS impressions, count(*) FILTER (value > 50) AS clicks FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
rated AS (SELECT *, CASE WHEN impressions = 0 THEN 0.0 ELSE clicks::DOUBLE / impressions END AS ctr FROM grouped),
arms AS (SELECT *, CAST(row_number() OVER (PARTITION BY test_id ORDER BY ctr DESC, headline) = 1 AS INT) AS best, CAST(row_number() OVER (PARTITION BY test_id ORDER BY headline) - 1 AS INT) AS local_idx FROM rated)"""
PAIRS = ARMS + """,
pairs AS (SELECT a.test_id, a.local_idx AS id_first, b.local_idx AS id_second, a.headline AS headline_first, b.headline AS headline_second, a.ctr AS ctr_first, b.ctr AS ctr_second, a.clicks AS clicks_first, b.clicks AS clicks_second, a.impressions AS impressions_first, b.impressions AS impressions_second
FROM arms a JOIN arms b ON a.test_id = b.test_id AND a.local_idx < b.local_idx WHERE a.ctr <> b.ctr AND trim(coalesce(a.headline, '')) <> '' AND trim(coalesce(b.headline, '')) <> '')"""


def _logit(p: str) -> str:
    c = f"greatest(1e-6, least(1 - 1e-6, {p}))"
    return f"ln({c} / (1 - {c}))"


def _beta(c: str, n: str) -> str:
    return _logit(f"(({c} + 0.5) / ({n} + 1.0))")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def arm_table(spark, sf_dir):
    return _rounded(arms(spark, sf_dir).select("test_id", "local_idx", "headline", "impressions", "clicks", "ctr", "best"))


def pair_table(spark, sf_dir):
    return _rounded(P.weighted(P.all_pairs(arms(spark, sf_dir))))


def pair_sample(spark, sf_dir):
    return P.sample_pairs(P.all_pairs(arms(spark, sf_dir)), 4).select("test_id", "id_first", "id_second")


def pair_orientation(spark, sf_dir):
    return P.orient(P.all_pairs(arms(spark, sf_dir))).select("test_id", "id_first", "id_second", "headline_first", "clicks_second")


def pair_enriched(spark, sf_dir):
    rows = arms(spark, sf_dir)
    return _rounded(P.enriched(P.all_pairs(rows), rows))


def best_worst_pairs(spark, sf_dir):
    return P.best_worst_pairs(arms(spark, sf_dir)).select("test_id", "id_first", "id_second", "headline_first", "headline_second")


def headline_lookup(spark, sf_dir):
    keys = P.all_pairs(arms(spark, sf_dir)).groupBy("test_id").agg(F.max("id_second").alias("local_idx"))
    return P.headline_lookup(keys, arms(spark, sf_dir)).select("test_id", "local_idx", "headline")


def clean_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("clean"))
    return rows.select("page_id", F.md5(F.col("clean").cast("binary")).alias("digest"), F.char_length("clean").alias("size"))


def keep_first(spark, sf_dir):
    return A.keep_first(table(spark, sf_dir, "documents"), ["lang", "source", "text"], "doc_id").select("doc_id")


def multi_row_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("k", F.md5(F.col("text").cast("binary")))
    return A.multi_row_groups(docs, "k").select("doc_id", "k")


def rate_profile(spark, sf_dir):
    return _rounded(A.rate_profile(arms(spark, sf_dir)))


def group_sizes(spark, sf_dir):
    return A.group_sizes(arms(spark, sf_dir).where("clicks > 20"), "test_id")


def arm_group_sizes(spark, sf_dir):
    """As group_sizes, over all arms; that query's arms have more than 20 clicks, so that some groups have one arm."""
    return A.group_sizes(arms(spark, sf_dir), "test_id")


def winner_agreement(spark, sf_dir):
    rows = arms(spark, sf_dir).withColumn("first_place", F.col("local_idx") == 0)
    both = [A.winner_agreement(rows, v, "first_place").withColumn("by", F.lit(v)) for v in ("ctr", "clicks")]
    return _rounded(both[0].unionByName(both[1]))


def winner_disagreements(spark, sf_dir):
    """All tests whose arm of the highest rate isn't the first one, with both rates and the first one's text."""
    return _rounded(A.winner_disagreements(arms(spark, sf_dir).withColumn("first_place", F.col("local_idx") == 0), "ctr", "first_place", "headline"))


def distinct_profile(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("level", F.floor(F.col("value") / 10))
    return _rounded(A.distinct_profile(events, "user_id", T.signature("event_type", "level")))


def token_profile(spark, sf_dir):
    return _rounded(A.number_profile(table(spark, sf_dir, "documents"), T.token_count(F.col("text"))))


def token_exceedance(spark, sf_dir):
    return _rounded(A.exceedance(table(spark, sf_dir, "documents"), T.token_count(F.col("text")), [64, 128, 256, 512, 1024]))


def token_bins(spark, sf_dir):
    return A.fixed_bins(table(spark, sf_dir, "conversations"), T.token_count(F.col("text")), [0, 10, 20, 50, 100])


def text_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(T.filled(F.col("text")))
    d = lambda c: F.md5(c.cast("binary"))
    return rows.select("doc_id", d(T.preview(F.col("text"), 60)).alias("preview"), d(T.prompt(F.col("text"))).alias("prompt"), dashboard_url("https://example.org/f", F.col("doc_id")).alias("url"))


def _part_names(spark, sf_dir):
    """Features of both spaces, names and width: every part key is an index."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("index"), F.col("p_name").alias("description"))
    width = (names.agg(F.max("index")).first()[0] or 0) + 1
    return spark.range(0, 2 * width).select(F.col("id").cast("int").alias("feature")), names, width


def feature_names(spark, sf_dir):
    return named(*_part_names(spark, sf_dir)).select("feature", "space_index", "name")


def missing_feature_names(spark, sf_dir):
    return missing_names(*_part_names(spark, sf_dir))


def group_split(spark, sf_dir):
    parts = S.group_split(P.all_pairs(arms(spark, sf_dir)), "test_id", 0.2, 0.1)
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("test_id").alias("tests"))


def group_leaks(spark, sf_dir):
    rows = P.all_pairs(arms(spark, sf_dir))
    by_pair = S.group_split(rows.withColumn("k", F.concat_ws("|", "test_id", "id_first", "id_second")), "k", 0.5)
    return S.leaking_groups(by_pair, "test_id").select("test_id", "parts")


def document_windows(spark, sf_dir):
    """The three longest documents of each source with their ranks, the smaller id first on ties."""
    by = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(by)).where("rank <= 3").select("source", "doc_id", "rank")


QUERIES = {f.__name__: f for f in (arm_table, pair_table, pair_sample, pair_orientation, pair_enriched, best_worst_pairs, headline_lookup, clean_pages, keep_first, multi_row_groups, rate_profile, group_sizes, arm_group_sizes, winner_agreement, winner_disagreements, distinct_profile, token_profile, token_exceedance, token_bins, text_forms, feature_names, missing_feature_names, group_split, group_leaks, document_windows)}

_TOKENS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{0B}\x{85}\p{Z}]+'), lambda x: x <> ''))"
_HASH = "md5('42|' || test_id || '|' || id_first || '|' || id_second)"
_SHARE = "('0x' || substr(md5('42|' || {}), 1, 12))::UBIGINT::DOUBLE / 281474976710656"

_FEATURES = "w AS (SELECT max(p_partkey) + 1 AS width FROM part), f AS (SELECT CAST(i AS INT) AS feature, CAST(i % width AS INT) AS space_index, width FROM (SELECT unnest(range(2 * width)) AS i, width FROM w))"

ORACLE_SQL = {
    "arm_table": f"WITH {ARMS} SELECT test_id, local_idx, headline, impressions, clicks, round(ctr, 6) AS ctr, best FROM arms",
    "pair_table": f"""WITH {PAIRS} SELECT test_id, id_first, id_second, headline_first, headline_second, clicks_first, clicks_second, impressions_first, impressions_second, round(ctr_first, 6) AS ctr_first, round(ctr_second, 6) AS ctr_second,
CAST(ctr_first > ctr_second AS INT) AS better_label, round(abs(ctr_first - ctr_second), 6) AS weight_diff, round(abs({_logit('ctr_first')} - {_logit('ctr_second')}), 6) AS weight_logit,
round(abs({_beta('clicks_first', 'impressions_first')} - {_beta('clicks_second', 'impressions_second')}) * sqrt(least(impressions_first, impressions_second)), 6) AS weight_beta,
round({_logit('ctr_first')} - {_logit('ctr_second')}, 6) AS target_logit_diff, round({_beta('clicks_first', 'impressions_first')} - {_beta('clicks_second', 'impressions_second')}, 6) AS target_smoothed, round(sqrt(least(impressions_first, impressions_second)), 6) AS weight_sqrt_min_impr FROM pairs""",
    "pair_sample": f"WITH {PAIRS} SELECT test_id, id_first, id_second FROM pairs QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY {_HASH}, id_first, id_second) <= 4",
    "pair_orientation": f"""WITH {PAIRS}, o AS (SELECT *, right(md5('43|' || test_id || '|' || id_first || '|' || id_second), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS odd FROM pairs)
SELECT test_id, CASE WHEN odd THEN id_second ELSE id_first END AS id_first, CASE WHEN odd THEN id_first ELSE id_second END AS id_second, CASE WHEN odd THEN headline_second ELSE headline_first END AS headline_first, CASE WHEN odd THEN clicks_first ELSE clicks_second END AS clicks_second FROM o""",
    "pair_enriched": f"""WITH {PAIRS}
SELECT p.test_id, p.id_first, p.id_second, coalesce(a.clicks, 0) AS clicks_first, coalesce(b.clicks, 0) AS clicks_second, coalesce(a.impressions, 0) AS impressions_first, coalesce(b.impressions, 0) AS impressions_second,
round(CASE WHEN a.ctr IS NULL OR b.ctr IS NULL THEN 0.0 ELSE {_logit('a.ctr')} - {_logit('b.ctr')} END, 6) AS target_logit_diff, round(CASE WHEN a.ctr IS NULL OR b.ctr IS NULL THEN 0.0 ELSE sqrt(least(a.impressions, b.impressions)) END, 6) AS weight_sqrt_min_impr, a.ctr IS NULL OR b.ctr IS NULL AS is_miss
FROM pairs p LEFT JOIN arms a ON a.test_id = p.test_id AND a.local_idx = p.id_first LEFT JOIN arms b ON b.test_id = p.test_id AND b.local_idx = p.id_second""",
    "best_worst_pairs": f"""WITH {ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY ctr DESC, headline) AS t, row_number() OVER (PARTITION BY test_id ORDER BY ctr, headline) AS l FROM arms)
SELECT a.test_id, a.local_idx AS id_first, b.local_idx AS id_second, a.headline AS headline_first, b.headline AS headline_second FROM r a JOIN r b ON a.test_id = b.test_id AND a.t = 1 AND b.l = 1 AND a.local_idx <> b.local_idx""",
    "headline_lookup": f"WITH {PAIRS}, k AS (SELECT test_id, max(id_second) AS local_idx FROM pairs GROUP BY 1) SELECT k.test_id, k.local_idx, coalesce(a.headline, '<unknown>') AS headline FROM k LEFT JOIN arms a ON a.test_id = k.test_id AND a.local_idx = k.local_idx",
    "clean_pages": r"""WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#\p{Nd}+;', '', 'g'), '&[\p{L}\p{M}\p{N}\p{Pc}]+;', '', 'g'), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')) AS clean FROM pages)
SELECT page_id, md5(clean) AS digest, CAST(length(clean) AS INT) AS size FROM c""",
    "keep_first": "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source, text ORDER BY doc_id) = 1",
    "multi_row_groups": "SELECT doc_id, md5(text) AS k FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1",
    "rate_profile": f"WITH {ARMS} SELECT count(ctr) AS n, round(min(ctr), 6) AS least, round(max(ctr), 6) AS most, round(avg(ctr), 6) AS mean, round(median(ctr), 6) AS median, round(stddev_pop(ctr), 6) AS std, count(*) FILTER (ctr = 0) AS zeros FROM arms",
    "group_sizes": f"WITH {ARMS}, s AS (SELECT test_id, count(*) AS c FROM arms WHERE clicks > 20 GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (c = 1) AS single, count(*) FILTER (c > 1) AS multi, max(c) AS largest FROM s",
    "arm_group_sizes": f"WITH {ARMS}, s AS (SELECT test_id, count(*) AS c FROM arms GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (c = 1) AS single, count(*) FILTER (c > 1) AS multi, max(c) AS largest FROM s",
    "winner_agreement": f"""WITH {ARMS}, w AS (SELECT 'ctr' AS "by", local_idx = 0 AS f FROM arms QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY ctr DESC, headline) = 1 AND count(*) OVER (PARTITION BY test_id) > 1
UNION ALL SELECT 'clicks', local_idx = 0 FROM arms QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY clicks DESC, headline) = 1 AND count(*) OVER (PARTITION BY test_id) > 1) SELECT "by", count(*) AS groups, count(*) FILTER (f) AS agree, round(avg(f::INT), 6) AS rate FROM w GROUP BY 1""",
    "winner_disagreements": f"""WITH {ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY ctr DESC, headline) AS t, count(*) OVER (PARTITION BY test_id) AS n FROM arms)
SELECT a.test_id, round(a.ctr, 6) AS best_value, round(b.ctr, 6) AS flagged_value, coalesce(substr(b.headline, 1, 60), 'N/A') AS flagged_text FROM r a JOIN r b ON b.test_id = a.test_id AND b.local_idx = 0 WHERE a.t = 1 AND a.n > 1 AND a.local_idx <> 0""",
    "distinct_profile": "WITH c AS (SELECT user_id, count(DISTINCT coalesce(event_type, '') || '|' || coalesce(CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), '')) AS n FROM events GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n > 1) AS varied, round(avg(n) FILTER (n > 1), 6) AS mean, round(median(n) FILTER (n > 1), 6) AS median, min(n) FILTER (n > 1) AS least, max(n) FILTER (n > 1) AS most FROM c",
    "token_profile": f"WITH t AS (SELECT {_TOKENS} AS v FROM documents) SELECT count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(min(v) AS INT) AS least, CAST(max(v) AS INT) AS most, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM t",
    "token_exceedance": f"WITH t AS (SELECT {_TOKENS} AS v FROM documents), l AS (SELECT unnest([64.0, 128.0, 256.0, 512.0, 1024.0])::DOUBLE AS lim) SELECT lim AS \"limit\", count(*) FILTER (v > lim) AS n, round(100.0 * count(*) FILTER (v > lim) / count(*), 6) AS percent FROM t, l GROUP BY lim",
    "token_bins": f"WITH t AS (SELECT {_TOKENS} AS v FROM conversations), b AS (SELECT unnest([0.0, 10, 20, 50, 100])::DOUBLE AS low, unnest([10.0, 20, 50, 100, NULL])::DOUBLE AS high) SELECT low, high, count(*) FILTER (v >= low AND (high IS NULL OR v < high)) AS n FROM t, b GROUP BY ALL",
    "text_forms": "SELECT doc_id, md5(CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END) AS preview, md5('<start_of_turn>user' || chr(10) || text || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)) AS prompt, 'https://example.org/f/' || doc_id AS url FROM documents WHERE trim(coalesce(text, '')) <> ''",
    "feature_names": f"WITH {_FEATURES} SELECT feature, space_index, (CASE WHEN feature >= width THEN 'diff' ELSE 'ctx' END) || '_' || space_index || '_' || substr(coalesce(p_name, ''), 1, 60) AS name FROM f LEFT JOIN part ON p_partkey = space_index",
    "missing_feature_names": f"WITH {_FEATURES} SELECT count(*) FILTER (p_name IS NULL) AS missing, count(*) AS features FROM f LEFT JOIN part ON p_partkey = space_index",
    "group_split": f"WITH {PAIRS}, s AS (SELECT *, {_SHARE.format('test_id')} AS h FROM pairs) SELECT CASE WHEN h < 0.2 THEN 'test' WHEN h < 0.30000000000000004 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT test_id) AS tests FROM s GROUP BY 1",
    "group_leaks": f"WITH {PAIRS}, s AS (SELECT test_id, {_SHARE.format(chr(39) + chr(39) + ' || test_id || ' + repr('|') + ' || id_first || ' + repr('|') + ' || id_second')} < 0.5 AS t FROM pairs) SELECT test_id, count(DISTINCT t) AS parts FROM s GROUP BY 1 HAVING count(DISTINCT t) > 1",
    "document_windows": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents QUALIFY rank <= 3",
}
