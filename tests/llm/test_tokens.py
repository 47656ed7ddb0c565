"""Token counts, packing and token files against the libraries themselves."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyarrow import orc
from tokenizers import Tokenizer

from variantlab.llm import packing
from variantlab.llm.frames import new_path
from variantlab.llm.queries import op2_token_counts, op5_best_fit_packing, op6_token_orc
from variantlab.llm.token_count import token_counts
from variantlab.llm.token_orc import read_token_orc, token_digests, write_token_orc

from .fixtures import DOCS, odd_docs, odd_texts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def counts(rows):
    tool = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = [(i, len((t or "").encode()), len(tool.encode(t or ""))) for i, t in rows]
    return sorted(((*r, r[2] > 4096) for r in out), key=str)


def ids_of(rows, end):
    tool = Tokenizer.from_file(WORDS)
    return [np.array([*tool.encode(t or "", add_special_tokens=False).ids, end], "<u4") for _, t in rows]


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


COUNT = ("doc_id", "n_bytes", "n_tokens", "over_limit")


def test_counts_of_the_whole_table(spark, sf_dir):
    assert rows_of(op2_token_counts(spark, sf_dir), *COUNT) == counts(documents(spark, sf_dir))


def test_counts_of_odd_rows_and_of_overlaps_that_must_widen(spark):
    rng = random.Random(3)
    rows = odd_texts() + [(300, "x" * 9000), (301, "ab" * 300 + " " + "word " * 900), (302, "  " * 4000), (303, "a\n" * 3000), (304, "".join(rng.choice("abc de\n\té日<s>") for _ in range(8000)))]
    docs = odd_docs(spark, rows)
    want = counts(rows)
    assert rows_of(token_counts(docs, PIECES), *COUNT) == want
    assert rows_of(token_counts(docs, PIECES, chunk=500, overlap=20), *COUNT) == want


def test_counts_of_texts_that_normalisation_changes(spark):
    """Ligatures, full-width letters, combining marks and wide spaces, so dense that chunk ends fall among them."""
    rng = random.Random(2)
    parts = ["ﬁ", "ﬀ", "Ａ", "ｂｃ", "e\u0301", "o\u0308\u0304", "\u3000", "½", "①", " ", "x", "the ", "ﷺ", "…"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(1500))) for k in range(4)] + [(9, "e" + "\u0301" * 900), (10, "ﬁ" * 900)]
    assert rows_of(token_counts(odd_docs(spark, rows), PIECES, chunk=200, overlap=10), *COUNT) == counts(rows)


def test_counts_of_an_empty_table(spark):
    assert token_counts(spark.createDataFrame([], DOCS), PIECES).collect() == []


def check_packing(rows, got, capacity=2048):
    """got: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Returns the number of sequences."""
    want = []
    for (i, _), ids in zip(rows, ids_of(rows, 0), strict=True):
        want += [(i, p, p * capacity, len(x), zlib.crc32(x.tobytes())) for p, x in enumerate(np.split(ids, range(capacity, len(ids), capacity)))]
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r[5]].append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r[3] for r in want) // capacity)


PLACES = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def test_packing_of_the_whole_table(spark, sf_dir):
    used, least = check_packing(documents(spark, sf_dir), rows_of(op5_best_fit_packing(spark, sf_dir), *PLACES))
    assert used <= 1.03 * least + 2


def test_packing_of_odd_rows(spark):
    rows = odd_texts()
    packed = packing.pack(odd_docs(spark, rows), WORDS, end_id=0, capacity=64)
    from pyspark.sql import functions as F

    got = rows_of(packed.pieces.withColumn("ids_crc32", F.crc32("ids")).join(packed.layout, "uid"), *PLACES)
    used, least = check_packing(rows, got, 64)
    assert used <= 1.1 * least + 2
    assert packing.pack(spark.createDataFrame([], DOCS), WORDS, end_id=0).sequences().collect() == []


def test_genetic_steps_keep_every_item():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 400)
    one, two = (packing._packed(lengths, rng.permutation(400), 100) for _ in range(2))
    child = packing.mutate(lengths, packing.crossover(lengths, one, two, 100, rng), 100, rng)
    assert (child >= 0).all() and (np.bincount(child, weights=lengths) <= 100).all()
    best = packing.evolve(lengths, [one, two], 100, 1, 20, 0)
    assert packing._score(lengths, best, 100) <= min(packing._score(lengths, b, 100) for b in (one, two))
    assert packing.least_bins(lengths, 100) <= best.max() + 1


def check_files(rows, got):
    pairs = sorted(zip(rows, ids_of(rows, 2), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    starts = {}
    at = 0
    for (i, _), ids in pairs:
        starts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for i, own in starts.items():
        mine = sorted((r for r in got if r[0] == i), key=lambda r: r[1])
        assert sorted(r[2:] for r in mine) == sorted(own)
        for r in mine:
            assert r[1] == at
            at += r[2]


PLACE = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_files_of_the_whole_table(spark, sf_dir):
    got = rows_of(op6_token_orc(spark, sf_dir), *PLACE)
    rows = documents(spark, sf_dir)
    assert len(got) == len(rows)
    check_files(rows, got)


def test_files_of_odd_rows(spark):
    rows = odd_texts()
    path = new_path(spark, "orc")
    write_token_orc(odd_docs(spark, rows), path, WORDS, end_id=2)
    files = read_token_orc(spark, path)
    got = rows_of(token_digests(files), *PLACE)
    assert len(got) == len(rows)
    check_files(rows, got)
    assert files.where("doc_id = 6").count() == 1
    path = new_path(spark, "orc")
    write_token_orc(spark.createDataFrame([], DOCS), path, WORDS, end_id=2)
    assert token_digests(read_token_orc(spark, path)).collect() == []


def full_bins(rng, bins, fewest, most, capacity):
    """Sizes that fill a known number of bins to the brim."""
    out = []
    for _ in range(bins):
        cuts = np.sort(rng.choice(np.arange(1, capacity), rng.integers(fewest, most + 1) - 1, replace=False))
        out += np.diff(np.concatenate(([0], cuts, [capacity]))).tolist()
    return np.array(out)


@pytest.mark.parametrize(("bins", "fewest", "most"), [(60, 2, 6), (100, 3, 6), (200, 2, 8)])
def test_islands_beat_best_fit_decreasing(spark, bins, fewest, most):
    """Groups built from known full bins, of which best fit decreasing needs one more: the islands find a division as good as that known."""
    rows, best_fit = [], 0
    for group in range(3):
        lengths = full_bins(np.random.default_rng(group), bins, fewest, most, 2048)
        best_fit += packing._packed(lengths, np.argsort(-lengths, kind="stable"), 2048).max() + 1
        rows += [(group * 100_000 + k, int(n), group) for k, n in enumerate(lengths)]
    layout = packing.islands(spark.createDataFrame(rows, "uid long, length long, grp long"), 2048).collect()
    sizes = {uid: n for uid, n, _ in rows}
    fill = defaultdict(int)
    for r in layout:
        fill[r.sequence_id] += sizes[r.uid]
    assert len(layout) == len(rows) and max(fill.values()) <= 2048
    assert best_fit == 3 * (bins + 1) and len(fill) == 3 * bins


def test_small_groups_are_packed_as_well_as_can_be():
    """Against a search of all divisions."""

    def least(items, free):
        if not items:
            return len(free)
        out = least(items[1:], [*free, 30 - items[0]])
        for k in {f: k for k, f in enumerate(free) if f >= items[0]}.values():
            out = min(out, least(items[1:], [*free[:k], free[k] - items[0], *free[k + 1 :]]))
        return out

    for seed in range(12):
        lengths = np.random.default_rng(seed).integers(4, 20, 8)
        start = [packing._packed(lengths, np.argsort(-lengths, kind="stable"), 30), packing._noisy(lengths, 30, np.random.default_rng(seed))]
        best = packing.evolve(lengths, start, 30, seed, packing.GENERATIONS, packing.least_bins(lengths, 30))
        assert best.max() + 1 == least(sorted(lengths.tolist(), reverse=True), [])


def test_token_files_have_stripes_row_indexes_and_bloom_filters(spark, tmp_path):
    """From the files' own metadata: several stripes whose statistics are disjoint id ranges, run-length encoded ids, Bloom filters; and a lookup that reads few rows."""
    rows = [(k, " ".join(f"w{(k * j) % 9973}" for j in range(12))) for k in range(0, 48_000, 2)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        write_token_orc(odd_docs(spark, rows), f"{tmp_path}/orc", WORDS, end_id=2, stripe_bytes=1 << 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    jvm = spark.sparkContext._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration()
    stripes, spans = 0, []
    for f in sorted((tmp_path / "orc").glob("*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        stripes += reader.getStripes().size()
        spans += [(x.getColumnStatistics()[1].getMinimum(), x.getColumnStatistics()[1].getMaximum()) for x in reader.getStripeStatistics() if x.getColumnStatistics()[1].getNumberOfValues()]
        inner = reader.rows()
        blooms = 0
        for info in reader.getStripes():
            footer = inner.readStripeFooter(info) if hasattr(inner, "readStripeFooter") else None
            kinds = [s.getKind().toString() for s in footer.getStreamsList()] if footer else []
            blooms += any(k.startswith("BLOOM_FILTER") for k in kinds)
            assert not footer or "ROW_INDEX" in kinds
        assert blooms == reader.getStripes().size()
    spans.sort()
    assert stripes > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    found = read_token_orc(spark, f"{tmp_path}/orc").where("doc_id = 4002")
    assert found.count() == 1 and read_token_orc(spark, f"{tmp_path}/orc").where("doc_id = 4003").count() == 0


def test_rows_of_one_id_start_where_they_lie(spark, tmp_path):
    """Physical rows, read file by file, begin at start also where several share a doc_id."""
    rows = [(7, f"{'word ' * (k * 7 % 5 + 3)}{k}") for k in range(8)] + [(k, "other words") for k in range(5, 10)] + [(None, "x"), (None, "y z")]
    write_token_orc(odd_docs(spark, rows).repartition(3), f"{tmp_path}/orc", WORDS, end_id=2)
    files = read_token_orc(spark, f"{tmp_path}/orc")
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_digests(files).collect()}
    at, seen = 0, 0
    key = lambda t: (t.column("doc_id")[0].as_py() is not None, t.column("doc_id")[0].as_py() or 0)
    for table in sorted((orc.read_table(p) for p in tmp_path.glob("orc/*.orc") if orc.read_table(p).num_rows), key=key):
        for doc_id, ids in zip(table.column("doc_id").to_pylist(), table.column("token_ids").to_pylist(), strict=True):
            assert digests[doc_id, at] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at, seen = at + len(ids), seen + 1
    assert seen == len(rows) == len(digests)


def test_digests_read_ids_once(spark, tmp_path):
    """Totals of files need no ids; a file whose n_tokens are not those of its ids is an error."""
    write_token_orc(odd_docs(spark, [(k, "some words " * k) for k in range(9)]), f"{tmp_path}/orc", WORDS, end_id=2)
    files = read_token_orc(spark, f"{tmp_path}/orc")
    plan = token_digests(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    files.selectExpr("doc_id", "place", "n_tokens + 1 AS n_tokens", "token_ids").write.orc(f"{tmp_path}/other")
    with pytest.raises(Exception, match="n_tokens is not"):
        token_digests(read_token_orc(spark, f"{tmp_path}/other")).collect()
