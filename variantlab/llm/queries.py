"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .collision_ann import nearest
from .decontaminate import WORD, decontaminate
from .frames import new_path
from .jaccard_join import jaccard_components
from .packing import pack
from .ring_shards import assign_shards
from .secret_scan import RULES, digests, secret_spans
from .suffix_dedup import without_repeats
from .tandem_runs import periodic_runs
from .token_count import token_counts
from .token_orc import read_token_orc, token_digests, write_token_orc
from .toxicity import toxicity
from .vector_codes import compressed
from .warc import read_warc, resolved, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
    pieces = packed.pieces.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces.join(packed.layout, "uid").drop("uid")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    write_token_orc(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_digests(read_token_orc(spark, path))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), shards=8)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(secret_spans(_table(spark, sf_dir, "documents")))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(_table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return codes.drop("label").withColumn("codebooks_sha256", F.lit(books.sha256()))


def _repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of a tenth of the documents, by the checksum of doc_id, repeat from a place on."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", number.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform("w", lambda w, i: F.when(i >= F.col("a"), F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(w))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_repeated(_table(spark, sf_dir, "documents")), least=6, times=4)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("top", longest).withColumn("length", -F.col("top.less"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "length", "top.period", F.expr("1000 * length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_collision_ann, op2_token_counts, op3_ngram_jaccard_join, op4_decontamination, op5_best_fit_packing,
        op6_token_orc, op7_toxicity, op8_ring_shards, op9_secret_scan, op10_warc_revisits, op11_suffix_dedup, op12_vector_codes,
        op13_tandem_runs,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secrets_sql() -> str:
    """A text's pieces between a rule's matches and the matches themselves, unnested in step; running lengths give positions."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT rid, {k} AS rank, '{r.name}' AS kind, generate_subscripts(w, 1) AS pos, unnest(g[1:len(w)]) AS gap, unnest(w) AS whole, unnest(p) AS part FROM "
        f"(SELECT rid, string_split_regex(text, {quoted(r.pattern)}) AS g, regexp_extract_all(text, {quoted(r.pattern)}, 0) AS w, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS p FROM d)"
        for k, r in enumerate(RULES)
    )
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), m AS ({kinds}),
s AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY rid, rank ORDER BY pos) AS stop FROM m),
k AS (SELECT rid, rank, kind, stop - length(whole) AS start, stop FROM s WHERE length(part) >= CASE rank {least} END),
a AS (SELECT rid, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM k GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


def _decontamination_sql(width: int) -> str:
    words = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
p AS (SELECT item_id, w, least({width}, len(w)) AS n, unnest(range(greatest(1, len(w) - {width - 1}))) AS b FROM i WHERE len(w) > 0), q AS (SELECT DISTINCT item_id, n, array_to_string(w[b + 1:b + n], ' ') AS win FROM p),
e AS (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS start FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n), f AS (SELECT rid, start, n, array_to_string(w[start + 1:start + n], ' ') AS win FROM e),
h AS (SELECT f.rid, f.start, f.n, q.item_id FROM f JOIN q ON q.n = f.n AND q.win = f.win), c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(start, start + n)) AS pos FROM h) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""


def _jaccard_sql(width: int, percent: int) -> str:
    words = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {width - 1}))) AS o FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[o + 1:o + {width}], ' ') AS x FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2), e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {100 + percent} * k >= {percent} * (x.n + y.n)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2"""


def _repeats_sql(length: int) -> str:
    """Bytes as two hex digits each, in pieces c as a place in a long text is slow to find: windows w, the first of equal ones stays, and the others' bytes are joined into spans and cut out."""
    return rf"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT rid, 500 * b AS base, substr(x, 1000 * b + 1, {1000 + 2 * length - 2}) AS y FROM d, unnest(range(len(x) // 1000 + 1)) t(b)),
w AS (SELECT rid, base + s AS s, md5_number(substr(y, 2 * s + 1, {2 * length})) AS m FROM c, unnest(range(len(y) // 2 - {length - 1})) t(s)), r AS (SELECT rid, s FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY rid, s) > 1),
i AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS island FROM (SELECT rid, s, CAST(s > coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s), -1000000) + {length} AS INT) AS new FROM r)),
p AS (SELECT rid, min(s) AS a, max(s) + {length} AS b FROM i GROUP BY rid, island),
k AS (SELECT rid, count(*) AS n, sum(b - a) AS gone, string_agg(substr(x, 2 * a0 + 1, 2 * (a - a0)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM (SELECT p.*, x, coalesce(lag(b) OVER (PARTITION BY p.rid ORDER BY a), 0) AS a0 FROM p JOIN d USING (rid)) GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """q: integer parts; each round assigns them (a) by distance, then index, and averages (c); materialised, as a round is read twice."""
    nearest = lambda books: f"SELECT q.rid, q.part, arg_min({{'e': entry, 'd': d}}, {{'d': d, 'e': entry}}) AS m FROM (SELECT q.rid, q.part, b.entry, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM q JOIN {books} b ON b.part = q.part) q GROUP BY 1, 2"
    steps = "".join(f""", a{r} AS MATERIALIZED ({nearest(f"c{r}")}), s{r} AS (SELECT q.part, m.e AS entry, generate_subscripts(q.x, 1) AS k, unnest(q.x) AS x FROM a{r} JOIN q USING (rid, part)),
f{r} AS (SELECT part, entry, list(v ORDER BY k) AS x FROM (SELECT part, entry, k, floor(sum(x) / count(*))::BIGINT AS v FROM s{r} GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(f{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN f{r} USING (part, entry))""" for r in range(rounds))  # fmt: skip
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT rid, p AS part, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) t(p)), c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM q WHERE rid <= {entries}){steps},
z AS MATERIALIZED ({nearest(f"c{rounds}")}), e AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM z GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (rid), h"""


def _runs_sql(least: int, times: int) -> str:
    """c: crc32 of doc_id, bit by bit; e: equal words q apart; stretches of these are runs, once for each period that they have, and the smallest stays."""
    bits = "list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: list_concat([ascii(s)::BIGINT], list_transform(range(8), lambda k: -1)))), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295::BIGINT)"
    return f"""WITH c AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor({bits}, 4294967295::BIGINT) AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c), b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
x AS MATERIALIZED (SELECT rid, doc_id, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM b, unnest(range(n)) t(i)),
e AS (SELECT l.rid, l.n, l.i, r.i - l.i AS q FROM x l JOIN x r ON r.rid = l.rid AND r.word = l.word AND r.i > l.i AND {times} * (r.i - l.i) <= l.n),
g AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e) GROUP BY rid, q, island),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM g WHERE length >= greatest({least}, {times} * q) GROUP BY 1, 2, 3),
t AS (SELECT rid, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'l': -length, 's': start, 'p': period}}) AS m, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
f AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r), k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN f USING (rid, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.s AS start, m.l AS length, m.p AS period, 1000 * m.l // m.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM c LEFT JOIN t USING (rid) LEFT JOIN k USING (rid)"""


_BASE32 = "array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(h, CAST(1 + 5 * (j // 4) AS INT), 5))::UBIGINT >> (15 - 5 * (j % 4))::UBIGINT) & 31) AS INT), 1)), '')"

#: Tokens, learning, hash rings and approximate search are beyond SQL; tests hold those queries against libraries and brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": _jaccard_sql(5, 75),
    "op4_decontamination": _decontamination_sql(10),
    "op9_secret_scan": _secrets_sql(),
    "op13_tandem_runs": _runs_sql(6, 4),
    "op11_suffix_dedup": _repeats_sql(100),
    "op12_vector_codes": _codes_sql(16, 64, 2),
    "op10_warc_revisits": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
