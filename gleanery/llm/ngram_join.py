"""N-gram Jaccard join: a grouped prefix join over sets of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import components, counted, materialize, release, small_batches, sweep

#: Documents of one token that are still compared as single pairs; larger buckets are compared in tiles.
PAIRED = 64
#: Rows of a tile's side, and shingles that they may hold together (one row of any length always fits).
TILE_ROWS, TILE_SHINGLES = 128, 1 << 21
#: Ids that are broadcast to pick the texts whose sets pairs ask for; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Tokens and documents of a chunk at most (a document of any length is whole), and about the tokens of a bucket.
CHUNK_TOKENS, CHUNK_DOCS, BUCKET_TOKENS = 1 << 21, 1 << 16, 1 << 20
#: Words whose hash a worker remembers.
REMEMBERED = 100_000


class _Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; with fewer words the whole sequence as one; empty without words.

    Words are runs of anything but [\\x20\\x09-\\x0D], A-Z lower-cased.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k]
    total ^= total >> np.uint64(29)
    return np.unique(total * np.uint64(0xBF58476D1CE4E5B9))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _length(n: int, num: int, den: int) -> int:
    """Shingles of a prefix: two sets above the threshold share one within them, in any common order."""
    return n - -(-n * num // den) + 1 if n else 0


def _width(num: int, den: int) -> int:
    """Of the 32 leading bits of a hash, how many values a class spans: about twice a prefix."""
    return min(1 << 32, max(1 << 28, -(-2 * (den - num) * (1 << 32) // den)))


def _shingled(docs: DataFrame, size: int, num: int, den: int, width: int) -> DataFrame:
    """Rows of documents (doc_id, n, dig, chunk, at, held) and rows of their tokens (chunk, bucket, low, owner).

    Tokens are the shingles of a document's first classes, as many classes as hold its prefix (held: how many in
    each). A chunk is some documents of one task; its tokens are dealt by hash into buckets: low has their 32 leading
    bits, owner the place ``at`` of each one's document in the chunk. Rows whose text is not that of their ``mark``
    (where docs has one that is not null) are left out.
    """
    n_tokens = int((docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0) / 5) * width >> 32
    buckets = max(16, n_tokens // BUCKET_TOKENS + 1)
    ends = np.array([k * width << 32 for k in range(1, -(-(1 << 32) // width))], dtype=np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("dig", pa.binary()), ("chunk", pa.int64()), ("at", pa.int32()), ("held", pa.list_(pa.int32())), ("bucket", pa.int64()), ("low", pa.binary()), ("owner", pa.binary())])

    def table(rows: list[tuple], *names: str) -> pa.RecordBatch:
        columns = dict(zip(names, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in schema], schema=schema)

    def written(chunk: int, rows: list[tuple], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield table(rows, "doc_id", "n", "dig", "chunk", "at", "held")
        owner = np.repeat(np.arange(len(tokens), dtype=np.uint16), [len(x) for x in tokens])
        every = np.concatenate(tokens)
        bucket = (every & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        low, owner = (every[order] >> np.uint64(32)).astype(np.uint32), owner[order]
        found, start = np.unique(bucket[order], return_index=True)
        if len(found):
            yield table([(chunk, k, x.tobytes(), y.tobytes()) for k, x, y in zip(found.tolist(), np.split(low, start[1:]), np.split(owner, start[1:]), strict=True)], "chunk", "bucket", "low", "owner")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, tokens, many = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for doc_id, text, mark in zip(*(batch.column(c) for c in ("doc_id", "text", "mark")), strict=True):
                doc_id, shingles, mark = doc_id.as_py(), shingle_set(text.as_py(), size), mark.as_py()
                n = len(shingles)
                if mark is not None and mark != _mark(_digest(shingles)):
                    continue
                if doc_id is None or not n:
                    rows.append((doc_id, n, None, chunk, len(rows), []))
                    tokens.append(shingles[:0])
                else:
                    held = np.append(np.searchsorted(shingles, ends), n)
                    held = held[: np.searchsorted(held, _length(n, num, den)) + 1]
                    rows.append((doc_id, n, _digest(shingles), chunk, len(rows), np.diff(held, prepend=0)))
                    tokens.append(shingles[: held[-1]])
                    many += int(held[-1])
                if len(rows) == CHUNK_DOCS or many >= CHUNK_TOKENS:
                    yield from written(chunk, rows, tokens)
                    chunk, rows, tokens, many = chunk + 1, [], [], 0
        if rows:
            yield from written(chunk, rows, tokens)

    return docs.select("doc_id", "text", "mark").mapInArrow(shingled, "doc_id long, n long, dig binary, chunk long, at int, held array<int>, bucket long, low binary, owner binary")


def _prefixed(shingled: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """(doc_id, n, dig, mark, pk, tok, pos) of the documents that can have a partner; copies are documents too.

    The common order of shingles: by class, then by the number of documents that hold the token, then by hash. Each
    bucket counts its tokens exactly and answers every chunk with those of several documents; what comes before them
    in a prefix is tokens of one document. A prefix of nothing else can't reach the threshold with any.
    """
    classes = -(-(1 << 32) // width)
    answer = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("low", pa.binary()), ("owner", pa.binary()), ("times", pa.binary())])
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("dig", pa.binary()), ("mark", pa.int64()), ("pk", pa.binary()), ("tok", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))])

    def count(pieces: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, dtype=np.uint32) for x in pieces.column("low").to_pylist()]
        owner = [np.frombuffer(x, dtype=np.uint16) for x in pieces.column("owner").to_pylist()]
        _, place, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        times = np.split(np.minimum(times, 0xFFFF).astype(np.uint16)[place], np.cumsum([len(x) for x in low])[:-1])
        again = [(x[t > 1].tobytes(), y[t > 1].tobytes(), t[t > 1].tobytes()) for x, y, t in zip(low, owner, times, strict=True)]
        columns = [pa.array(c, pa.binary()) for c in zip(*again, strict=True)]
        return pa.Table.from_arrays([pieces.column("chunk"), pieces.column("bucket"), *columns], schema=answer)

    def prefixed(named: pa.Table, answers: pa.Table) -> pa.Table:
        if not named.num_rows or not answers.num_rows:
            return schema.empty_table()
        named = named.sort_by("at")
        held = np.zeros((named.num_rows, classes), dtype=np.int64)
        for k, x in enumerate(named.column("held").to_pylist()):
            held[k, : len(x)] = x
        n = named.column("n").to_numpy()
        length = np.array([_length(int(x), num, den) for x in n])
        low, owner, times = (np.concatenate([np.frombuffer(x, dtype=kind) for x in answers.column(c).to_pylist()]).astype(np.int64) for c, kind in (("low", np.uint32), ("owner", np.uint16), ("times", np.uint16)))
        tok = np.repeat(answers.column("bucket").to_numpy(), [len(x) // 4 for x in answers.column("low").to_pylist()]) << 32 | low
        group = owner * classes + low // width
        order = np.lexsort((tok, times, group))
        tok, owner, group = tok[order], owner[order], group[order]
        again = np.bincount(group, minlength=held.size)
        first = (np.cumsum(held, axis=1) - held).ravel() + held.ravel() - again  # lower classes, then what one document holds
        pos = first[group] + np.arange(len(group)) - (np.cumsum(again) - again)[group]
        keep = pos < length[owner]
        keep[1:] &= (tok[1:] != tok[:-1]) | (owner[1:] != owner[:-1])  # two shingles of one token count once
        tok, owner, pos = tok[keep], owner[keep], pos[keep].astype(np.int32)
        if not len(tok):
            return schema.empty_table()
        living, start = np.unique(owner, return_index=True)
        rows = []
        whole = named.take(pa.array(living)).select(["doc_id", "dig"]).to_pylist()
        for k, x, t, p in zip(living.tolist(), whole, np.split(tok, start[1:]), np.split(pos, start[1:]), strict=True):
            # A prefix with a shingle of one document only is that document's alone.
            pk = x["dig"] if len(t) < length[k] else hashlib.blake2b(t.tobytes() + int(n[k]).to_bytes(8, "little"), digest_size=16).digest()
            rows.append((x["doc_id"], int(n[k]), x["dig"], _mark(x["dig"]), pk, t, p))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    answers = shingled.where("bucket is not null").select("chunk", "bucket", "low", "owner").groupBy("bucket").applyInArrow(count, "chunk long, bucket long, low binary, owner binary, times binary")
    named = shingled.where("bucket is null").select("chunk", "at", "doc_id", "n", "dig", "held")
    return named.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(prefixed, "doc_id long, n long, dig binary, mark long, pk binary, tok array<long>, pos array<int>")


def _mark(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _may_link(n: Column, pos: Column, other_n: Column, other_pos: Column, num: int, den: int) -> Column:
    """Size filter, and position filter: what two sets can still share from a common shingle at these positions on."""
    sizes = F.least(n, other_n) * den >= F.greatest(n, other_n) * num
    return sizes & (F.least(n - pos, other_n - other_pos) * (num + den) >= (n + other_n) * num)


def _texts(docs: DataFrame, reps: DataFrame, many: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``reps`` (rep, mark; ``many`` rows), with its mark: up to ``BROADCAST_IDS`` are broadcast, so that texts nobody asks for are not shuffled; more are joined."""
    reps = reps.select(F.col("rep").alias("doc_id"), "mark")
    return docs.drop("mark").join(F.broadcast(reps) if many <= BROADCAST_IDS else reps, "doc_id").select("doc_id", "text", "mark")


def _sets(docs: DataFrame, size: int, digests: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the representatives (digests: rep, mark) in ``ids`` (column doc_id), made from their texts again."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                rows = []
                for doc_id, text, mark in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "mark")), strict=True):
                    shingles = shingle_set(text, size)
                    if _mark(_digest(shingles)) == mark:
                        rows.append((doc_id, shingles.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "shingles"])

    wanted, many = counted(digests.select("rep", "mark").join(ids.select(F.col("doc_id").alias("rep")).distinct(), "rep", "left_semi"), "ids")
    sets = materialize(_texts(docs, wanted, many).mapInArrow(shingled, "doc_id long, shingles binary"), "wanted")
    release(wanted)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Merge joins on plain exchanges, which Spark splits where one document leads many.
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).hint("merge")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")).hint("merge")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _tiled(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components of large buckets (rows: token, rep, c, most).

    Pairs inside a bucket's largest component need no comparison. The other members, its strays, are dealt into
    blocks, and so are all members; each block of strays meets each block of members in a tile, which returns a
    spanning forest of the links it finds. A bucket with few strays costs work in proportion to its size.
    """

    def compare(tile: pa.Table) -> pa.Table:
        rep, side, c = (tile.column(x).to_numpy() for x in ("rep", "side", "c"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in tile.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        stray, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = np.zeros((len(stray), len(other)), dtype=np.float32)
        for low in range(0, int(place[-1]) + 1, 4096):
            part = slice(*np.searchsorted(place, (low, low + 4096)))
            held = np.zeros((len(sets), 4096), dtype=np.float32)
            held[row[part], place[part] - low] = 1
            both += held[stray] @ held[other].T
        both = both.astype(np.int64)
        linked = (den * both >= num * (sizes[stray][:, None] + sizes[other] - both)) & (c[stray][:, None] != c[other])
        label, before = np.arange(len(sets)), None
        while before is None or (label != before).any():
            before = label.copy()
            reached = np.where(linked, label[stray][:, None], len(sets)).min(0, initial=len(sets))
            label[other] = np.minimum(label[other], reached)
            reached = np.where(linked, label[other], len(sets)).min(1, initial=len(sets))
            label[stray] = np.minimum(label[stray], reached)
        tied = label != np.arange(len(sets))
        return pa.table({"a": rep[label[tied]], "b": rep[tied]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    held = rows.groupBy("token", "c").agg(F.count("*").alias("k"), F.max("most").alias("most"))
    per = F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_SHINGLES) / F.col("most"))))
    main = held.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("members"), (F.sum("k") - F.max("k")).alias("strays"), F.max("most").alias("most"))
    main = main.select("token", "main", F.ceil(F.col("strays") / per).alias("rows_"), F.ceil(F.col("members") / per).alias("columns_"))
    dealt = materialize(rows.drop("most").join(main, "token"), "dealt")
    to = lambda many, column: F.expr(f"pmod(xxhash64(rep, {many}), {column})")
    each = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))
    strays = dealt.where("c <> main").select("token", to(0, "rows_").alias("i"), each("columns_").alias("j"), F.lit(0).alias("side"), "rep", "c")
    all_ = dealt.select("token", each("rows_").alias("i"), to(1, "columns_").alias("j"), F.lit(1).alias("side"), "rep", "c")
    full = strays.union(all_).join(sets.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    return full.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; two documents link when den * intersection >= num * union.

    component_id is the smallest doc_id reachable by links, itself included. Null, empty and blank texts have an
    empty set and link with nothing. Rows without a doc_id link with nothing and have no component; rows that share
    one are one document with several texts. Texts of any length count whole. Other columns are ignored.

    0. Exact counts of the shingles in a fraction of the hash values leave out the documents whose prefix, with these
       shingles before all others, no other document shares; what is left is counted again with all its shingles.
    1. Equal sets become one representative. Representatives with equal size and prefix become one group, and
       groups meet in an inverted index of their prefix shingles (exact by the prefix principle: two sets above the
       threshold share a shingle of both prefixes, in any common order).
    2. Each bucket of the index pairs its groups with its first group only; pairs that pass the size and position
       filters are expanded to members and verified on whole sets. Linked documents are one component from here on.
    3. Buckets that still hold several components are completed, still by groups: in small ones the pairs of groups
       that pass the filters and are not of one component are expanded to the members of different components; in
       large ones the members outside the bucket's largest component are compared with all in tiles. Buckets with
       the same groups are compared once. So a group of copies costs work in proportion to its size where its first
       document links it together, and never one row for each of its pairs.

    Tokens are counted exactly, by buckets of hashes, so what is written and shuffled grows in proportion to the
    texts however many there are; shuffle files are deleted phase by phase. Only sets that a pair asks for are made
    again from the texts and shuffled. Identity of shingles is that of 64-bit hashes (of tokens, which only choose
    pairs, less), of sets and of buckets that of 128-bit digests.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sweep(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("mark"))
    shingled = materialize(_shingled(docs, size, num, den, _width(num, den)), "shingled")
    digests, many = counted(_prefixed(shingled, num, den, _width(num, den)).groupBy("dig").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "mark")).alias("r")).select("dig", "r.*"), "digests")
    named = materialize(shingled.where("bucket is null").select("doc_id", "n", "dig"), "named")
    release(shingled)
    sweep(spark)
    # Again with all shingles as tokens, of the representatives that are left and counted among them.
    shingled = materialize(_shingled(_texts(docs, digests, many), size, num, den, 1 << 32), "shingled")
    # Rows that share a doc_id and a text are one here.
    reps = materialize(_prefixed(shingled, num, den, 1 << 32).select(F.col("doc_id").alias("rep"), "n", "pk", "tok", "pos").distinct(), "reps")
    release(shingled)
    sweep(spark)
    first = F.min_by(F.struct(F.col("rep").alias("gid"), "n", "tok", "pos"), "rep").alias("r")
    groups = materialize(reps.groupBy("pk").agg(first, F.count("*").alias("size")).select("pk", "r.*", "size"), "groups")
    crowds = reps.select("pk", "rep").join(groups.where("size > 1").select("pk", "gid"), "pk")
    each = lambda df, *keep: df.select(*keep, F.explode(F.arrays_zip("tok", "pos")).alias("at")).select(*keep, F.col("at.tok").alias("token"), F.col("at.pos").alias("pos"))

    indexed = each(groups, "gid", "n")
    lead = indexed.groupBy("token").agg(F.min(F.struct("gid", "n", "pos")).alias("lead"), F.count("*").alias("c"))
    leads = materialize(lead.where("c > 1").select("token", F.col("lead.gid").alias("a"), F.col("lead.n").alias("an"), F.col("lead.pos").alias("ap")), "leads")
    star = indexed.join(leads, "token").where("gid <> a").where(_may_link(F.col("n"), F.col("pos"), F.col("an"), F.col("ap"), num, den))
    met = star.select("a", "gid").distinct().join(crowds.select("gid", "rep"), "gid", "left").select("a", F.coalesce("rep", "gid").alias("b"))
    first_pairs = materialize(met.where("a <> b").union(crowds.where("gid <> rep").select("gid", "rep")).distinct(), "pairs")
    ends = lambda df: df.select("a").union(df.select("b")).withColumnRenamed("a", "doc_id")
    asked = _sets(docs, size, digests, ends(first_pairs))
    first_links = materialize(_verified(first_pairs, asked, num, den), "links")
    release(asked)
    sweep(spark)

    known = components(first_links).withColumnRenamed("node", "rep")
    state = materialize(reps.select("pk", "rep").join(known, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"), "state")
    spans = state.groupBy("pk").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    indexed = each(groups.join(spans, "pk"), "gid", "n", "size", "low", "high")
    xor = [F.bit_xor(F.xxhash64("gid", F.lit(k))).alias(f"h{k}") for k in range(2)]
    mixed = indexed.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("members"), F.max("n").alias("most"), F.count("*").alias("k"), F.sum("pos").alias("places"), *xor)
    # Of buckets with the same groups the one earliest in the common order: the position filter holds at a pair's first common shingle.
    mixed = mixed.where("low <> high").groupBy("k", "h0", "h1").agg(F.min_by(F.struct("token", "members", "most"), F.struct("places", "token")).alias("m")).select("m.*")
    rows = materialize(indexed.join(mixed, "token"), "rows")
    crowds = materialize(state.join(groups.where("size > 1").select("pk", "gid"), "pk").select("gid", "rep", "c"), "crowds")

    few = rows.where(F.col("members") <= PAIRED)
    x, y = (few.select("token", *(F.col(c).alias(p + c) for c in ("gid", "n", "low", "high", "pos"))) for p in "xy")
    near = x.join(y, "token").where("xgid <= ygid and (xlow <> xhigh or ylow <> yhigh or xlow <> ylow)")
    near = near.where(_may_link(F.col("xn"), F.col("xpos"), F.col("yn"), F.col("ypos"), num, den)).select("xgid", "xlow", "ygid", "ylow").distinct()
    for p in "xy":
        near = near.join(crowds.select(F.col("gid").alias(f"{p}gid"), F.col("rep").alias(f"{p}rep"), F.col("c").alias(f"{p}c")), f"{p}gid", "left")
        near = near.withColumns({f"{p}rep": F.coalesce(f"{p}rep", f"{p}gid"), f"{p}c": F.coalesce(f"{p}c", f"{p}low")})
    pairs = near.where("xc <> yc").select(F.least("xrep", "yrep").alias("a"), F.greatest("xrep", "yrep").alias("b")).distinct()
    done = first_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    large = rows.where(F.col("members") > PAIRED).select("token", "gid", F.col("low"), "most").join(crowds, "gid", "left")
    large = materialize(large.select("token", F.coalesce("rep", "gid").alias("rep"), F.coalesce("c", "low").alias("c"), "most"), "large")
    sweep(spark)
    wanted = _sets(docs, size, digests, ends(pairs).union(large.select("rep")))
    tiles = materialize(_tiled(large, wanted, num, den), "tiles")
    links = first_links.union(_verified(pairs, wanted, num, den)).union(tiles)

    final = components(links)
    labels = materialize(digests.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("dig", F.coalesce("component", "rep").alias("component_id")), "labels")
    release(reps, groups, leads, first_pairs, first_links, state, rows, crowds, pairs, large, wanted, tiles, digests)
    sweep(spark)
    linked = named.where("dig is not null").join(labels, "dig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.union(named.where("dig is null").select("doc_id", "n", "doc_id"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document's component over 4-word shingles at Jaccard 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3]))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v WHERE reach.r < l.b)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.r) AS component_id FROM sets s JOIN reach r ON r.v = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
