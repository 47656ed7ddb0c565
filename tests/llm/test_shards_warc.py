"""Shards and archives against plain computations."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from variantlab.llm.frames import new_path
from variantlab.llm.queries import op8_ring_shards, op10_warc_revisits
from variantlab.llm.ring_shards import assign_shards, ring, write_shards
from variantlab.llm.warc import read_warc, records, resolved, write_warc

from .fixtures import DOCS, odd_docs, odd_texts


def check_shards(rows, got, shards=8):
    sizes = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sizes
    counts = Counter(r.shard for r in got)
    full = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(full) - min(full) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def test_shards_of_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_ring_shards(spark, sf_dir).collect()
    check_shards(rows, got)
    assert sum(r.shard == r.home_shard for r in got) > 0.8 * len(got)


def test_shards_of_odd_rows(spark):
    rows = odd_texts()
    check_shards(rows, assign_shards(odd_docs(spark, rows)).collect())
    check_shards(rows[:3], assign_shards(odd_docs(spark, rows[:3]), 5).collect(), 5)
    assert assign_shards(spark.createDataFrame([], DOCS)).collect() == []


def test_a_new_shard_takes_rows_and_moves_few_others():
    old, new = ring(8), ring(9)
    assert [x for x in new if x[1] < 8] == old


def test_growth_moves_few(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one = assign_shards(docs, 8).select("doc_id", F.col("shard").alias("a"))
    two = assign_shards(docs, 9).select("doc_id", F.col("shard").alias("b"))
    moved = one.join(two, "doc_id").where("a <> b").count()
    assert moved < 4000 * 0.35


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(pages):
    first: dict = {}
    for i, html in pages:
        if i is not None:
            first[digest(html)] = min(first.get(digest(html), i), i)
    out = []
    for i, html in pages:
        d = digest(html)
        revisit = d in first and i != first[d]
        out.append((i, len((html or "").encode()), d, "revisit" if revisit else "response", first[d] if revisit else None))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_archive_of_the_whole_table(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert rows_of(op10_warc_revisits(spark, sf_dir)) == brute(pages)


def test_archive_of_odd_rows(spark):
    pages = [(1, "<p>a</p>"), (2, "<p>a</p>"), (3, None), (4, ""), (5, "x\r\n\r\nWARC/1.1\r\n\r\n y"), (6, "é😀\n" * 1000), (7, "é😀\n" * 1000), (None, "<p>a</p>"), (8, "\r\n\r\n"), (9, "z" * 500_000), (1, "<p>a</p>")]
    urls = ["http://a/ b", None, "http://c\r\nX: y", "http://d", "", "http://é", *["http://g"] * 5]
    table = spark.createDataFrame([(i, u, h, 1, "d") for (i, h), u in zip(pages, urls, strict=True)], "page_id long, url string, html string, payload_bytes int, payload_digest string")
    path = new_path(spark, "warc")
    write_warc(table, path)
    archive = read_warc(spark, path)
    assert rows_of(resolved(archive)) == brute(pages)
    texts = {r.page_id: bytes(r.payload).decode() for r in archive.where("record_type = 'response'").collect()}
    assert texts[5] == pages[4][1] and texts[6] == pages[5][1] and texts[9] == pages[9][1]
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame([], table.schema), path)
    assert resolved(read_warc(spark, path)).collect() == []


def test_files_are_members_that_can_be_reached_alone(spark, tmp_path):
    """Several bounded files, each with a warcinfo first; every record is a gzip member that reads alone from its offset; a long one is several."""
    import gzip
    import io
    import random
    import zlib

    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh", k=17_000_000))
    pages = [(k, f"http://p/{k}", f"<p>{k % 40}</p>" * 300) for k in range(120)] + [(500, "http://long", long)]
    write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w", file_bytes=40_000)
    files = sorted(p for p in (tmp_path / "w").rglob("part-*"))
    assert len(files) > 3
    seen = 0
    for f in files:
        data, kinds = f.read_bytes(), []
        while data:
            one = zlib.decompressobj(31)
            text = one.decompress(data)
            assert one.eof
            if text.startswith(b"WARC/1.1"):
                kinds.append(next(records(io.BytesIO(text)))[0]["warc-type"] if text.endswith(b"\r\n\r\n") and len(text) < 1_000_000 else "part of one")
            data = one.unused_data
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        assert sum(1 for _ in records(gzip.open(f))) == len(kinds)
        seen += len(kinds) - 1
    assert seen == len(pages)
    assert rows_of(resolved(read_warc(spark, f"{tmp_path}/w"))) == brute([(i, h) for i, _, h in pages])


def test_archive_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr("variantlab.llm.frames.BROADCAST_ROWS", 0)
    pages = [(k, f"u{k}", f"<p>{k % 3}</p>") for k in range(30)] + [(None, None, "<p>1</p>")]
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    assert rows_of(resolved(read_warc(spark, path))) == brute([(i, h) for i, _, h in pages])


def placed_one_by_one(keys, owners, capacity):
    """Documents (arc, key) placed clockwise one after another in ring order: own shards first, then what overflows."""
    room, out, late = list(capacity), {}, []
    for arc, key in sorted(keys):
        if room[owners[arc]]:
            room[owners[arc]] -= 1
            out[key] = owners[arc]
        else:
            late.append((arc, key))
    for arc, key in late:
        step = next(s for s in range(1, len(owners) + 1) if room[owners[(arc + s) % len(owners)]])
        shard = owners[(arc + step) % len(owners)]
        room[shard] -= 1
        out[key] = shard
    return out


def test_flow_equals_placing_documents_one_by_one(spark):
    docs = spark.range(700).select((F.col("id") * 7).alias("doc_id"), F.lit("x").alias("text"))
    for shards in (1, 3, 8):
        nodes = ring(shards)
        places, owners = [p for p, _ in nodes], [s for _, s in nodes]
        at = {r.doc_id: r.at for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("at")).collect()}
        keys = [(sum(p < a for p in places) % len(places), (a, d)) for d, a in at.items()]
        capacity = [700 // shards + (s < 700 % shards) for s in range(shards)]
        want = {d: s for (_, d), s in placed_one_by_one(keys, owners, capacity).items()}
        assert {r.doc_id: r.shard for r in assign_shards(docs, shards).collect()} == want


def test_shards_are_written(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    write_shards(docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 40 and {r["count"] for r in back.groupBy("shard").count().collect()} == {10}
