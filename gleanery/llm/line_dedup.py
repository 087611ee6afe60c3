"""Line dedup: two Bloom filters find suspected repeats, only those are shuffled and confirmed by their whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BLANKS, fresh, lower_ascii, materialize, release, small_batches
from gleanery.llm.sketch import build, cells_for

#: Spark's xxhash64 starts from this seed.
SPARK_SEED = 42
CELLS_PER_LINE = 8
PROBES = 2
#: Ids of documents that lose lines which are broadcast (16 bytes each), so that the others stay where they are.
BROADCAST_IDS = 2_000_000
#: Texts that a Python worker cuts at once.
AT_ONCE = 200


def line_keys(text: Column, min_chars: int) -> Column:
    """The distinct keys of a text's lines that are long enough to be judged."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(lower_ascii(line), F.lit(BLANKS)))
    return F.array_distinct(F.filter(keys, lambda key: F.char_length(key) >= min_chars))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with each repeated line left only in the document of the smallest doc_id that holds it.

    A line's key is the line, A-Z lower-cased, without white space at either end. Keys of at least ``min_chars``
    code points that at least two documents hold lose all their lines in every document but the first; lines
    repeated inside one document only stay. Adds n_lines (before) and n_dropped; columns of those names are
    replaced, all others are kept. A null or empty text has one empty line and comes back empty. Rows that share a
    doc_id count as one document. Rows without a doc_id keep all their lines and make no line a repeat.

    Texts and lines of any length count whole, and columns of any other name are kept, also those named like inner
    ones. One pass fills the filters with 8-byte hashes, one pass sends on only the lines whose hash the second
    filter holds. Those are grouped by their whole text with partial aggregation, so a line that every document
    holds is one row for each task; the join back to the suspects has plain exchanges on both sides, which are split
    when skewed. Only documents that lose lines are shuffled with their text, while their ids are few enough to be
    broadcast; beyond that all are.
    """
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), line_keys(F.col("text"), min_chars).alias("keys"))
    n_lines = docs.select(F.sum(F.size(F.split("text", "\n"))).alias("n")).first().n or 0
    hashes = known.select(F.explode(F.transform("keys", lambda key: F.xxhash64(key))).alias("h"))
    sketch = build(hashes, lambda batch: batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), cells_for(n_lines, CELLS_PER_LINE), PROBES, at_once=100_000)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = shared.value.repeated(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(held))

    lines = known.select("doc_id", F.explode("keys").alias("key")).withColumn("h", F.xxhash64("key"))
    suspects = materialize(lines.mapInArrow(suspected, "doc_id long, key string, h long"), "suspects")
    held = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeats = materialize(held.where("first <> last").select("key", "first"), "repeats")
    plain = docs.drop("n_lines", "n_dropped")
    id_, gone = fresh(plain, "doc"), fresh(plain, "drops")
    drops = suspects.join(repeats, "key").where("doc_id <> first").groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list("h").alias(gone))
    drops = materialize(drops, "drops")
    release(suspects, repeats)
    same = F.col("doc_id").cast("long") == F.col(id_)
    if drops.count() <= BROADCAST_IDS:
        losers = F.broadcast(drops.select(id_))
        whole, joined = plain.join(losers, same, "left_anti"), plain.join(losers, same, "left_semi").join(drops, same)
    else:
        whole, joined = None, plain.join(drops, same, "left")
    long_ = lambda column: column.cast("long")
    schema = plain.withColumn("n_lines", long_(F.lit(0))).withColumn("n_dropped", long_(F.lit(0))).schema
    names = plain.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for k in range(0, large.num_rows, AT_ONCE):
                batch = large.slice(k, AT_ONCE)
                texts, before, dropped = [], [], []
                for text, drop in zip(batch.column("text").to_pylist(), batch.column(gone).to_pylist(), strict=True):
                    found = (text or "").split("\n")
                    before.append(len(found))
                    if drop:
                        out = {h & 0xFFFFFFFFFFFFFFFF for h in drop}
                        found = [x for x in found if xxhash.xxh64_intdigest(x.encode().lower().strip(), SPARK_SEED) not in out]
                    texts.append("\n".join(found))
                    dropped.append(before[-1] - len(found))
                columns = {name: pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in names}
                yield pa.RecordBatch.from_pydict(columns | {"n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    cut = joined.drop(id_).mapInArrow(kept, schema)
    if whole is None:
        return cut
    text = F.coalesce("text", F.lit(""))
    return whole.withColumns({"text": text, "n_lines": long_(F.size(F.split(text, "\n"))), "n_dropped": long_(F.lit(0))}).union(cut)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: how many lines it had and lost, and the digest of what stays."""
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, string_split(coalesce(d.text, ''), chr(10))[u.pos] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS pos) u),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(r.first <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
