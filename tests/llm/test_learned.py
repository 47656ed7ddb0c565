"""Toxicity on held-out rows, and nearest neighbours by recall against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest

from variantlab.llm.collision_ann import BLOCK, Block, nearest
from variantlab.llm.queries import op1_collision_ann, op7_toxicity
from variantlab.llm.toxicity import toxicity

from .fixtures import DOCS, odd_docs, odd_texts


def area(y, s):
    ranks = pd.Series(s).rank().to_numpy()
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = op7_toxicity(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    y = held.toxic.to_numpy()
    assert area(y, held.score) > 0.9
    assert ((held.predicted == 1) & (y == 1)).sum() >= 0.8 * y.sum() and ((held.predicted == 1) & (y == 0)).sum() <= 0.05 * (y == 0).sum()


def test_toxicity_of_odd_rows(spark):
    rows = odd_texts()
    docs = odd_docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(range(1, 90))] + [(None, 1, 1), (3, 1, None), (999, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("toxic = 0"), labels.limit(0)):
        got = toxicity(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert toxicity(spark.createDataFrame([], DOCS), labels).collect() == []


def exact(ids, x, k=20, every=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_on_the_whole_table(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    want = exact(data.vec_id.to_numpy(), np.stack(data.embedding).astype(float))
    got = op1_collision_ann(spark, sf_dir).toPandas()
    hit = 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 21))
        assert list(zip(-rows.score, rows.vec_id, strict=True)) == sorted(zip(-rows.score, rows.vec_id, strict=True))
        hit += len(set(rows.vec_id) & {v for v, _ in want[q]})
    assert got.query_id.nunique() == len(want) and hit >= 0.9 * 20 * len(want)


def test_windows_prune_where_vectors_have_structure():
    """A block of full size, vectors around 200 centres: few are verified, and the neighbours are among them."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((200, 64))
    x = centres[rng.integers(200, size=BLOCK)] + 0.3 * rng.standard_normal((BLOCK, 64))
    ids = np.arange(BLOCK)
    block = Block(ids, x, 0)
    want = exact(ids, x, 20, 400)
    found = verified = 0
    for q, best in want.items():
        rows, _, _ = block.arrays.search(x[q], 21, block.start)
        verified += len(rows)
        found += len(set(block.nearest(q, x[q], 20, 20)[0].tolist()) & {v for v, _ in best})
    assert found >= 0.9 * 20 * len(want) and verified <= 0.15 * BLOCK * len(want)


def test_odd_vectors(spark):
    rows = [(k, [float(k % 7), 1.0, -float(k)]) for k in range(41)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0]), (None, [1.0, 2.0, 3.0]), (40, [5.0, 1.0, -40.0]), (120, [1.0, 1.0, 1.0]), (121, [1.0, 1.0, 1.0])]
    docs = spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, block int")
    got = nearest(docs).toPandas()
    assert set(got.query_id) == {0, 20, 40, 120}
    fine = [(i, v) for i, v in rows if i is not None and (i < 41 or i >= 120)]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    for q in (0, 20, 120):
        mine = got[got.query_id == q].sort_values("rank")
        s = sorted(((-float(x[j] @ x[list(ids).index(q)]), int(ids[j])) for j in range(len(ids)) if ids[j] != q))[:20]
        assert len(mine) == 20 and len(set(zip(-mine.score, mine.vec_id, strict=True)) & set(s)) >= 18
    assert nearest(docs.limit(0)).collect() == []
    assert nearest(docs.where("vec_id in (0, 1)")).select("query_id", "rank", "vec_id").collect() == [(0, 1, 1)]
