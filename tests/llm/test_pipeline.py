"""The pipeline's stages on rows whose ids are null, repeated or stand for several texts."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline

from variantlab.llm.frames import stored

from .fixtures import DOCS, odd_docs, odd_texts, sentence
from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as components
from .test_secrets import SECRETS, plain as redacted_plainly
from .test_tokens import PLACES, check_packing


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def tables(spark, path, labels, bench):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_toxic_rows_go_by_row(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    clean, foul = [sentence(rng, 30) for _ in range(2)], "vile " + sentence(rng, 10)
    docs = [(1, clean[0]), (1, foul), (2, clean[1]), (None, foul), (None, clean[0]), (3, foul), (3, foul), (4, None)]
    judge = lambda df, labels, **more: df.selectExpr("doc_id", *more.get("named_by", ()), "int(coalesce(text LIKE 'vile%', false)) AS predicted")
    monkeypatch.setattr(pipeline, "toxicity", judge)
    got = rows_of(pipeline.toxicity_stage(spark, odd_docs(spark, docs), tables(spark, tmp_path, [(1, 0, 1)], [(1, "x")])))
    assert got == sorted(((i, t) for i, t in docs if t != foul), key=str)


def test_all_toxic_labels_reject_every_row(spark, tmp_path):
    docs = odd_docs(spark, [(k, "a b c") for k in range(12)] + [(None, "a b c"), (None, None)])
    assert rows_of(pipeline.toxicity_stage(spark, docs, tables(spark, tmp_path, [(k, 0, 1) for k in range(12)], [(1, "x")]))) == []


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(5)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    near = " ".join([*b.split()[:20], "other", *b.split()[21:]])
    docs = [(4, a), (4, a), (3, a), (3, c), (None, b), (None, b), (None, near), (None, c), (7, d), (7, d), (8, None), (None, "")]
    out = [(3, a), (3, c), (7, d), (8, None), (None, "")]
    got = rows_of(pipeline.jaccard_stage(spark, odd_docs(spark, docs), ""))
    assert [r for r in got if r not in out] in ([(None, b)], [(None, near)])
    assert [r for r in got if r in out] == sorted(out, key=str)
    numbered = components(list(enumerate(t for _, t in docs)))
    assert len(got) == len({group for _, _, group in numbered})


def test_contaminated_rows_go_by_row(spark, tmp_path):
    rng = random.Random(6)
    item, clean = sentence(rng, 15), sentence(rng, 40, 50)
    docs = [(1, clean), (1, clean + " " + item), (None, item), (None, clean), (2, item), (2, item), (3, None)]
    bad = {r[0] for r in contaminated(list(enumerate(t for _, t in docs)), [(1, item)]) if r[5]}
    got = rows_of(pipeline.decontamination_stage(spark, odd_docs(spark, docs), tables(spark, tmp_path, [(1, 0, 1)], [(1, item)])))
    assert got == sorted((r for k, r in enumerate(docs) if k not in bad), key=str)


def test_near_copies_are_taken_out_where_texts_lie(spark, monkeypatch):
    """Beyond any broadcast limit: texts are stored once before the join, and neither there nor after it are they shuffled to drop copies."""
    monkeypatch.setattr("variantlab.llm.frames.BROADCAST_ROWS", 1)
    kept = []

    def counted(df, name, own=stored):
        kept.extend([name] * ("text" in df.columns))
        return own(df, name)

    monkeypatch.setattr(pipeline, "stored", counted)
    monkeypatch.setattr("variantlab.llm.jaccard_join.stored", counted)
    rng = random.Random(6)
    texts = [sentence(rng, 60) for _ in range(40)]
    docs = [(k, t) for k, t in enumerate(texts + [t + " end" for t in texts] + texts)]
    out = pipeline.jaccard_stage(spark, odd_docs(spark, docs).repartition(4), "")
    assert kept == ["numbered"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert rows_of(out) == sorted(docs[:40], key=str)


def test_secrets_are_replaced_by_text(spark):
    one, two = "x password=abcdefgh1 y", "longer text, then token=12345678 and z"
    docs = [(1, one), (1, two), (1, "clean"), (None, one), (None, "clean"), (None, None), (2, SECRETS[3][1]), (2, one)]
    got = rows_of(pipeline.secrets_stage(spark, odd_docs(spark, docs), ""))
    mark = {one: "x [SECRET] y", two: "longer text, then [SECRET] and z", SECRETS[3][1]: "f" * 31 + " [SECRET]g[SECRET]"}
    assert got == sorted(((i, mark.get(t, t)) for i, t in docs), key=str)


def plain(docs, bench):
    """Rows that the first four stages keep, texts redacted: plain Python over numbered rows, judged toxic where they begin with vile."""
    rows = [(k, i, t) for k, (i, t) in enumerate(docs) if not (t or "").startswith("vile")]
    groups: dict = {}
    for (_, _, group), row in zip(sorted(components([(k, t) for k, _, t in rows])), sorted(rows), strict=True):
        groups.setdefault(group, []).append(row)
    rows = [min(g, key=lambda r: (r[1] is None, r[1] or 0, r[0])) for g in groups.values()]
    bad = {r[0] for r in contaminated([(k, t) for k, _, t in rows], bench) if r[5]}
    return [(i, redacted_plainly(t)) for k, i, t in rows if k not in bad]


def test_whole_pipeline_equals_a_plain_one(spark, tmp_path, monkeypatch):
    judge = lambda df, labels, **more: df.selectExpr("doc_id", *more.get("named_by", ()), "int(coalesce(text LIKE 'vile%', false)) AS predicted")
    monkeypatch.setattr(pipeline, "toxicity", judge)
    rng = random.Random(8)
    item = sentence(rng, 14)
    docs = odd_texts(7) + SECRETS + [(400, "vile " + sentence(rng, 20)), (None, "vile"), (401, sentence(rng, 30) + " " + item), (402, item), (400, "kept under one id with a vile one"), (None, sentence(rng, 12) + " password=abcdefgh99")]
    bench = [(1, item), (2, None), (3, "one two")]
    path = tables(spark, tmp_path, [(1, 0, 1)], bench)
    odd_docs(spark, docs).write.parquet(f"{path}/documents.parquet")
    table = spark.read.parquet(f"{path}/documents.parquet")
    want, kept = plain(docs, bench), table
    for name, stage in pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, path), name)
        assert kept.columns == table.columns and dict(kept.dtypes) == dict(table.dtypes)
    # of equal rows the one that stays is any, so that texts and ids are compared
    assert rows_of(kept) == sorted(want, key=str)
    got = [tuple(r) for r in pipeline.run(spark, path).select(*PLACES).collect()]
    check_packing(want, got)


def test_stages_of_an_empty_table(spark, tmp_path):
    path = tables(spark, tmp_path, [(1, 0, 1), (2, 0, 0)], [(1, "a b")])
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() == 0
    assert pipeline.run(spark, path).count() == 0


def test_columns_of_any_name_stay(spark, tmp_path):
    text = sentence(random.Random(2), 30)
    rows = [(1, text, 5, "r", 1, 2), (2, text + " end", 6, "s", 3, 4), (3, "x password=abcdefgh1 y", 7, "t", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row int, row string, __group int, blob int")
    path = tables(spark, tmp_path, [(k, 0, k % 2) for k in range(9)], [(1, "nothing of these documents at all")])
    kept = docs
    for _, stage in pipeline.STAGES[1:-1]:
        kept = stored(stage(spark, kept, path), "kept")
        assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], (3, "x [SECRET] y", *rows[2][2:])]
    assert pipeline.toxicity_stage(spark, docs, path).columns == docs.columns
