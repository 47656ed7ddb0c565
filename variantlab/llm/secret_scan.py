"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every text is a blob named by the SHA-256 of its content. The ledger holds which blobs each version of each
rule has seen, and the findings. A scan takes one copy of each blob, applies the rules whose version the ledger
lacks for it, appends to the ledger, and joins the findings to all paths (documents) of each blob.

Positions come from splitting a text at the rule's matches: gaps and matches alternate, and a window sums their
lengths, so that work and memory follow the number of matches in a text however many there are.

Defined results: null text is empty and has no spans; repeated rows are paths of one blob and all are returned, and
one id may name several blobs; a null doc_id is kept, scanned and redacted as others are; very long texts and texts
with very many matches are scanned whole; other columns are ignored, and kept by redacted whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .frames import fresh, keyed, new_path, stored, word_text


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group has least characters or more. quick: text that any match that counts must contain."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: Fixed values of the rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


MATCH = "struct<rank:int,kind:string,gap:int,size:int,counts:boolean>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """The matches of a rule, leftmost and not overlapping, in order: the code points before each since the last one, its own, and whether it counts."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.slice(F.split(text, rule.pattern), 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    sizes = lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(rule.name).alias("kind"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("size"), (F.char_length(x["part"]) >= rule.least).alias("counts"))
    return F.when(text.rlike(rule.pattern), F.transform(rows, sizes)).otherwise(F.array().cast(f"array<{MATCH}>"))


def located(found: DataFrame) -> DataFrame:
    """(blob, span) of the matches that count, from rows (blob, row, pos, m) of matches m in order pos."""
    till = F.sum(F.col("m.gap") + F.col("m.size")).over(W.partitionBy("blob", "row", "m.rank").orderBy("pos")).cast("int")
    each = found.select("blob", "m", till.alias("end")).where("m.counts")
    return each.select("blob", F.struct((F.col("end") - F.col("m.size")).alias("start"), F.col("m.rank").alias("rank"), F.col("m.kind").alias("kind"), "end").alias("span")).distinct()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).parquet(path)


_SEEN = "blob string, rule string, version int"
_FOUND = f"blob string, rule string, version int, span {SPAN}"


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger up to date with docs and returns (doc_id, blob, spans) for every path; spans are sorted by start, then kind."""
    spark = docs.sparkSession
    text = word_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    paths = stored(rows.select("doc_id", F.sha2("text", 256).alias("blob")), "paths")
    blobs = stored(paths.groupBy("blob").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")), "blobs")
    seen = _read(spark, f"{ledger}/seen", _SEEN)
    if seen is None:
        todo = blobs.withColumn("rules", F.array(*[F.lit(r.name) for r in rules]))
        # an id may stand for several texts, so copies are skipped by id and blob
        skip = paths.join(blobs.where("copies > 1").select("blob", "kept"), "blob").where("doc_id > kept").select("doc_id", "blob").distinct()
        fresh = keyed(rows.withColumn("blob", F.sha2("text", 256)), skip, ["doc_id", "blob"], "left_anti")
        fresh = fresh.withColumn("rules", F.array(*[F.lit(r.name) for r in rules]))
    else:
        done = seen.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
        wanted = F.array(*[F.when(~F.array_contains(F.coalesce("done", F.array().cast("array<string>")), f"{r.name}@{r.version}"), F.lit(r.name)) for r in rules])
        todo = stored(blobs.join(done, "blob", "left").withColumn("rules", F.array_compact(wanted)).where(F.size("rules") > 0).select("blob", "kept", "rules"), "todo")
        open_ids = todo.select(F.col("kept").alias("doc_id"))
        fresh = keyed(rows, open_ids.distinct(), "doc_id", "left_semi").unionByName(rows.where("doc_id IS NULL"))
        fresh = fresh.withColumn("blob", F.sha2("text", 256)).join(todo.select("blob", "rules"), "blob")
    each = F.flatten(F.array(*[F.when(F.array_contains("rules", r.name), matches(F.col("text"), r, k)).otherwise(F.array().cast(f"array<{MATCH}>")) for k, r in enumerate(rules)]))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    found = located(fresh.select("blob", F.monotonically_increasing_id().alias("row"), each.alias("m")).select("blob", "row", F.posexplode("m").alias("pos", "m")))
    found = found.select("blob", F.col("span.kind").alias("rule"), version[F.col("span.kind")].alias("version"), "span")
    found.write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.explode("rules").alias("rule")).select("blob", "rule", version[F.col("rule")].alias("version")).write.mode("append").parquet(f"{ledger}/seen")
    current = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
    kept = spark.read.schema(_FOUND).parquet(f"{ledger}/findings").where(F.array_contains(current, F.concat_ws("@", "rule", "version")))
    grouped = kept.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return keyed(paths, grouped, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """A scan with a ledger of its own."""
    return scan(docs, new_path(docs.sparkSession, "ledger"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of a scan's rows."""
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line, 256).alias("base_sha256"), line.alias("spans"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark; touching or overlapping spans give one mark. A row's spans are those of its text's blob.

    Windows over a blob's spans give the stretches between marks; each is cut from the text's fixed-width form, so
    the work follows the text's length and the number of spans, not their product.
    """
    each = found.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).distinct()
    reach = F.coalesce(F.max("s.end").over(W.partitionBy("blob").orderBy("s.start", "s.end").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    each = each.select("blob", reach.alias("reach"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    stretch = F.when(F.col("start") > F.col("reach"), F.struct(F.greatest("reach", F.lit(0)).alias("at"), F.col("start").alias("to")))
    blob, cuts, tail = fresh(docs, "blob", "cuts", "tail")
    table = each.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(stretch)).alias(cuts), F.max("end").alias(tail))
    text, wide = F.col("text"), F.encode(F.col("text"), "UTF-32")
    piece = lambda at, to: F.decode(F.substr(wide, 4 * at + 1, 4 * (to - at)), "UTF-32")
    pieces = F.concat(F.transform(cuts, lambda c: piece(c["at"], c["to"])), F.array(piece(F.col(tail), F.char_length(text))))
    joined = keyed(docs.withColumn(blob, F.sha2(word_text(), 256)), table, blob, "left")
    return joined.withColumn("text", F.when(F.col(cuts).isNotNull() & text.isNotNull(), F.array_join(pieces, mark)).otherwise(text)).select(*docs.columns)
