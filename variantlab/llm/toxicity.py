"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities (words, and word beginnings, that occur with toxic labels far beyond chance),
the nearness of second-person words to lexicon words, capitals, punctuation and obfuscation rates. Lexicon and trees
are learned on one part of the labelled rows, the calibration on another; both parts together are a sample of at most
MAX_LABELLED documents, one text for each id, and the lexicon has at most MAX_LEXICON units. The calibrated score is a
step function; 98 % of it and 2 % of the trees' own score are added, so that documents on one step have an order.

Defined results: null and empty texts have a score too, from features of no words; repeated rows are scored each, and of
several texts of one id the smallest is learned from; very long texts are scored whole;
a null doc_id is kept and is not held out; labels that are null or without a document are ignored; with labels of one
class only the score is that class's share; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from .frames import stored, word_text

#: At most this many labelled rows are learned from, chosen by hash.
MAX_LABELLED = 20_000
#: At most this many lexicon units.
MAX_LEXICON = 5_000
#: Least likelihood ratio (G squared) and log odds of a lexicon unit.
LEAST_G2, LEAST_ODDS = 22.0, 2.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos ti tus tú usted ustedes vosotros vuestro os".split())
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[A-Za-z][0-9@$*!#|]+[A-Za-z]")
_RUN = re.compile(r"([A-Za-z!?.])\1{2,}")
N_FEATURES = 15


def units(word: str) -> list[str]:
    """The lexicon units of a lower-case word: itself and its beginnings, which end with *."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def learned_lexicon(texts: DataFrame) -> dict[str, float]:
    """Units of labelled texts (text, toxic) with their log odds."""

    def run(batches):
        seen, bad = Counter(), Counter()

        def flush():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["unit", "n", "bad"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {u for w in set(_WORD.findall(text.lower())) for u in units(w)}
                seen.update(found)
                if toxic:
                    bad.update(found)
            if len(seen) > 500_000:
                yield flush()
                seen.clear()
                bad.clear()
        yield flush()

    n, t = texts.agg(F.count("*"), F.sum("toxic")).first()
    counts = texts.select("text", "toxic").mapInArrow(run, "unit string, n long, bad long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    share = t / n
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    a, b = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double")
    g2 = 2 * (part(a, F.col("n") * share) + part(b, F.col("n") * (1 - share)))
    odds = F.log((a + 0.25) / (t + 0.5)) - F.log((b + 0.25) / (n - t + 0.5))
    top = counts.where("bad >= 4").select("unit", g2.alias("g2"), odds.alias("odds")).where(f"g2 >= {LEAST_G2} AND odds >= {LEAST_ODDS}")
    return {r["unit"]: float(r["odds"]) for r in top.orderBy(F.desc("g2"), "unit").limit(MAX_LEXICON).collect()}


def features(text: str, lexicon: dict[str, float], heads: set[str]) -> list[float]:
    """The dense features of a text; heads holds the first letters of all lexicon units."""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    size = max(1, len(text))
    at, weights = [], []
    for i, w in enumerate(words):
        if w[:3] in heads:
            found = [lexicon[u] for u in units(w) if u in lexicon]
            if found:
                at.append(i)
                weights.append(max(found))
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    gap = 50.0
    if at and you:
        spots = np.array(you)
        near = np.searchsorted(spots, at)
        gap = float(min(50, np.abs(spots[np.minimum(near, len(you) - 1)] - at).min(), np.abs(spots[np.maximum(near - 1, 0)] - at).min()))
    letters = sum(map(len, words))
    capitals = sum(1 for c in text if c.isupper()) if not text.isascii() else len(re.findall("[A-Z]", text))
    distinct = len({words[i] for i in at})
    return [
        float(len(at)), len(at) / n, float(distinct), max(weights, default=0.0), sum(weights), sum(weights) / n,
        sum(1 for w in weights if w >= 4) / n, gap, len(you) / n, capitals / max(1, letters), (text.count("!") + text.count("?")) / n,
        (size - letters - text.count(" ")) / size, len(_MASKED.findall(text)) / n, len(_RUN.findall(text)) / n, float(np.log1p(len(words))),
    ]


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """rows (.., text) with a column features instead of text."""
    link = rows.sparkSession.sparkContext.broadcast((lexicon, {u[:3] for u in lexicon}))
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", features array<double>"

    def run(batches):
        words, heads = link.value
        for batch in batches:
            got = [features(t, words, heads) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(got, pa.list_(pa.float64()))], names=[*kept, "features"])

    return rows.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, threshold: float = THRESHOLD, named_by: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, and its columns named_by."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named_by, word_text().alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(fold(F.col("doc_id")) != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    sample = stored(rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("part", (fold(F.col("doc_id")) == (held_out + 1) % 4).cast("int")), "sample").repartition(8, "doc_id")
    sample = stored(sample, "sample")
    counts = {(r[0], r[1]): r[2] for r in sample.groupBy("part", "toxic").count().collect()}
    total = sum(counts.values())
    base = sum(v for (_, t), v in counts.items() if t) / total if total else 0.0
    held = F.coalesce(fold(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out")
    result = lambda score, df: df.select("doc_id", *named_by, held, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    if not counts.get((0, 0)) or not counts.get((0, 1)):
        return result(F.lit(float(base)), rows)
    train = sample.where("part = 0").select("doc_id", "toxic", "text")
    lexicon = learned_lexicon(train)
    vector = array_to_vector("features").alias("features")
    fit = stored(with_features(train, lexicon), "features").coalesce(4).select(vector, F.col("toxic").cast("double").alias("label"))
    trees = GBTClassifier(maxDepth=3, maxIter=20, stepSize=0.3, maxBins=64, minInstancesPerNode=4, seed=7, subsamplingRate=1.0).fit(fit)
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    scored = raw(with_features(rows, lexicon).select("doc_id", *named_by, vector)).select("doc_id", *named_by, "raw")
    if counts.get((1, 0)) and counts.get((1, 1)):
        rest = raw(with_features(sample.where("part = 1").select("toxic", "text"), lexicon).select("toxic", vector)).select("raw", F.col("toxic").cast("double").alias("label")).coalesce(4)
        steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(rest)
        x, y = np.array(steps.boundaries.toArray()), np.array(steps.predictions.toArray())

        @F.pandas_udf("double")
        def calibrated(p: pd.Series) -> pd.Series:
            # the calibrated level, and a small share of the trees' own score to order equal levels
            return pd.Series(np.clip(0.98 * np.interp(p, x, y) + 0.02 * p, 0, 1))

        scored = scored.withColumn("raw", calibrated("raw"))
    return result(F.col("raw"), scored)
