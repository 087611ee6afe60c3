"""Benchmark decontamination: spaced seeds join test and training texts, hits are verified with substitutions allowed. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import fresh, materialize

#: A 1 is a word that a seed hashes, a 0 one that it ignores. Of any 15 words with 3 substitutions, one of these masks still fits somewhere.
MASKS = ("110111", "1011011")
#: Masks of shorter items, by their words, where those above would miss some pattern of the substitutions allowed.
SHORT = {5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 7: (*MASKS, "11111")} | dict.fromkeys((10, 11, 12), (*MASKS, "11100011"))
#: An overlap is ``SPAN`` words (a whole shorter item) of which ``SHARE`` percent agree.
SPAN, SHARE = 15, 80
#: Items of fewer words are no evidence: such phrases stand in texts that never saw the benchmark.
LEAST = 5
#: Seeds of the benchmark that are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 4_000_000


def _key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda word: F.xxhash64(word))


def _hashed(mask: str):
    picked = [k for k, used in enumerate(mask) if used == "1"]
    return lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(mask), *[F.get(F.col("t"), i + k) for k in picked]).alias("h"))


def masks_for(words: int) -> tuple[str, ...]:
    """The masks that an item of so many words needs so that no allowed pattern of substitutions escapes."""
    return SHORT.get(words, MASKS)


def _seeds(rows: DataFrame, key: str, masks: list[str]) -> DataFrame:
    """(key, pos, h) of every mask at every position of the word hashes in column t."""
    hashed = []
    for mask in masks:
        many = F.greatest(F.size("t") - len(mask) + 1, F.lit(0))
        at = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
        hashed.append(F.transform(at, _hashed(mask)))
    found = rows.select(key, F.explode(F.concat(*hashed)).alias("s"))
    return found.select(key, "s.pos", "s.h")


def find_overlaps(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_key, item_id, start, matched, length) of every aligned overlap of a text with a benchmark item.

    doc_key is the text's MD5, so copies are verified once and rows without an id are judged too. Words are runs of
    letters and digits, lower-cased. An alignment counts if ``SPAN`` consecutive words of the item (all its words
    inside the text, where they are fewer) agree in at least ``SHARE`` percent of the words asked for; the masks of
    ``masks_for`` find every such alignment of items of ``least`` (5 or more) words. start is the word of the text
    where the item would begin (negative if it begins before), matched the words that agree, length the item's
    words. Null and empty texts, null item_ids and items of fewer than ``least`` words overlap with nothing. Texts of
    any length count whole. Other columns are ignored.

    The benchmark's seeds are broadcast below a counted bound, so the training side is not shuffled; only texts
    that a seed hits are gathered again, once for each distinct text. The training side is hashed by the masks that
    the items need.
    """
    if least < min(SHORT):
        raise ValueError(f"no masks for items of fewer than {min(SHORT)} words")
    keyed = docs.where("text is not null").select(_key().alias("doc_key"), "text")
    tests = items.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("t")).where(F.size("t") >= least)
    tests = materialize(tests.distinct(), "items")
    short = {r.n for r in tests.where(F.size("t") < SPAN).select(F.size("t").alias("n")).distinct().collect()}
    kinds: dict[tuple[str, ...], list[int]] = {MASKS: []}
    for n in sorted(short):
        kinds.setdefault(masks_for(n), []).append(n)
    other = [n for kind, lengths in kinds.items() if kind != MASKS for n in lengths]
    parts = [_seeds(tests.where(F.size("t").isin(lengths) if kind != MASKS else ~F.size("t").isin(other)), "item_id", list(kind)) for kind, lengths in kinds.items()]
    seeds = materialize(reduce(DataFrame.union, parts).select("item_id", F.col("pos").alias("item_pos"), "h"), "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds, near = F.broadcast(seeds), F.broadcast(tests)
    else:
        near = tests
    used = list(dict.fromkeys(mask for kind in kinds for mask in kind))
    hits = _seeds(keyed.select("doc_key", word_hashes(F.col("text")).alias("t")), "doc_key", used).join(seeds, "h")
    aligned = materialize(hits.select("doc_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("start")).distinct(), "hits")
    suspects = materialize(aligned.select("doc_key").distinct(), "suspects")
    texts = materialize(keyed.join(suspects, "doc_key", "left_semi").groupBy("doc_key").agg(F.first("text").alias("text")), "texts")
    words = texts.select("doc_key", word_hashes(F.col("text")).alias("d"))
    both = aligned.join(words, "doc_key").join(near, "item_id")
    low, high = F.greatest(F.lit(0), -F.col("start")), F.least(F.size("t"), F.size("d") - F.col("start"))
    agree = F.transform(F.sequence(F.col("low"), F.col("high") - 1), lambda k: (F.get(F.col("t"), k) == F.get(F.col("d"), k + F.col("start"))).cast("int"))
    both = both.select("doc_key", "item_id", "start", "t", "d", low.alias("low"), high.alias("high")).where("high > low")
    both = both.select("doc_key", "item_id", "start", F.size("t").alias("length"), agree.alias("agree"))
    both = both.withColumn("span", F.least(F.lit(SPAN), F.size("agree")))
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("span") + 1), lambda k: add(F.slice("agree", k, F.col("span"))))
    need = F.ceil(F.least(F.lit(SPAN), F.col("length")) * SHARE / 100)
    found = both.where(F.array_max(sums) >= need).withColumn("matched", add("agree"))
    return found.select("doc_key", "item_id", *(F.col(c).cast("long") for c in ("start", "matched", "length")))


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id of every overlap, with the best alignment's start, matched and length; rows that share doc_id and text are listed as often as they occur."""
    best = F.max_by(F.struct("start", "matched", "length"), F.struct("matched", -F.col("start"))).alias("b")
    found = materialize(find_overlaps(docs, items).groupBy("doc_key", "item_id").agg(best).select("doc_key", "item_id", "b.*"), "overlaps")
    rows = docs.where("text is not null").select("doc_id", _key().alias("doc_key"))
    return rows.join(found, "doc_key").drop("doc_key")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, columns as they are, whatever their names; null and empty texts stay."""
    key = fresh(docs, "key")
    found = materialize(find_overlaps(docs.select("text"), items).select(F.col("doc_key").alias(key)).distinct(), "overlaps")
    return docs.join(found, _key() == F.col(key), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated_pairs(docs, items)


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, ws FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark) WHERE len(ws) >= {LEAST}),
dw AS (SELECT doc_id, len(ws) AS dn, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM d),
bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM b),
m AS (SELECT doc_id, item_id, dw.pos - bw.pos AS start, any_value(dn) AS dn, any_value(n) AS n, list(bw.pos) AS ks
  FROM dw JOIN bw USING (w) GROUP BY doc_id, item_id, dw.pos - bw.pos HAVING count(*) >= ceil(least(5, any_value(n)) * 0.8)),
r AS (SELECT *, greatest(0, -start) AS low, least(n, dn - start) AS high FROM m),
v AS (SELECT *, least({SPAN}, high - low) AS span FROM r),
ok AS (SELECT doc_id, item_id, start, len(ks) AS matched, n AS length FROM v
  WHERE list_max(list_transform(range(low, high - span + 1), lambda s: len(list_filter(ks, lambda k: k >= s AND k < s + span)))) >= ceil(least({SPAN}, n) * {SHARE} / 100.0))
SELECT doc_id, item_id, start, matched, length FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""
