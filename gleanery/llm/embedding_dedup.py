"""Embedding near-dedup: one navigable small-world graph per shard, every vector asks every shard, links are verified and united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import components, materialize, release, small_batches
from gleanery.llm.hnsw import TOGETHER, Graph

#: Rows of a shard at most; below that there are as many shards as the cluster runs tasks.
SHARD_ROWS = 100_000
#: Queries of one task, bytes of one row that holds a part of a graph.
SLICE_ROWS, PIECE_BYTES = 50_000, 4 << 20
#: First beam, the beam from which exact comparison with the whole shard is cheaper, vectors of an audit, recall it asks for.
BEAM, WIDEST, AUDITED, RECALL = 24, 1024, 512, 0.98
#: Tasks that ask, however many pairs of a shard and a slice there are; nodes of one side of a tile that counts links.
MOST_TASKS, TILE = 10_000, 512
#: Single precision cosines this much below the threshold are verified in double precision.
SLACK = 1e-4

_PIECES = "dim int, shard int, slice int, kind int, piece int, uid long, data binary"


def _unit(vectors: DataFrame):
    """Embeddings (floats as they are, other numbers in double precision) where all components are finite and not all zero, else null."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(F.coalesce(good, F.lit(False)), v)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _normal(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _hits(graph: Graph, base: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of every link found: beams widen for queries whose beam is full of links, and end in a comparison with all vectors of the shard."""
    found_q, found_n, left = [], [], np.arange(len(queries))
    while len(left):
        wide = beam >= min(WIDEST, len(base))
        if wide:
            parts = [np.nonzero(queries[left[k : k + 128]] @ base.T >= threshold) for k in range(0, len(left), 128)]
            q = np.concatenate([p[0] + 128 * k for k, p in enumerate(parts)])
            n = np.concatenate([p[1] for p in parts])
            found_q.append(left[q])
            found_n.append(n)
            break
        ids, cosines = graph.near(queries[left], beam)
        full = (ids[:, -1] >= 0) & (cosines[:, -1] >= threshold - SLACK)
        q, k = np.nonzero((cosines >= threshold - SLACK) & (ids >= 0) & ~full[:, None])
        n = ids[q, k]
        exact = np.einsum("nd,nd->n", queries[left[q]], base[n]) >= threshold
        found_q.append(left[q[exact]])
        found_n.append(n[exact])
        left, beam = left[full], beam * 4
    return np.concatenate(found_q) if found_q else np.zeros(0, np.int64), np.concatenate(found_n) if found_n else np.zeros(0, np.int64)


def _audited_beam(graph: Graph, base: np.ndarray, threshold: float) -> int:
    """The narrowest of the doubled beams that passes a recall audit.

    The audit asks for evenly spread vectors of the shard, and for as many planted ones whose cosine to such a vector
    is just above the threshold, the hardest links there are; brute force over the shard gives the truth. Each query
    that has links counts the same, however many it has; a vector's hit of itself doesn't count. Of either kind the
    mean recall must be RECALL.
    """
    own = np.linspace(0, len(base) - 1, min(AUDITED, len(base))).astype(np.int64)
    sample = base[own]
    noise = np.random.default_rng(0).normal(size=sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    edge = min(1.0, threshold + 0.005)
    planted = edge * sample + np.sqrt(1 - edge * edge) * noise / np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
    asked, many = np.concatenate((sample, planted)), len(own)
    truth = np.concatenate([(asked[k : k + 128] @ base.T >= threshold).sum(1) for k in range(0, len(asked), 128)])

    def recall(beam: int) -> float:
        q, n = _hits(graph, base, asked, threshold, beam)
        itself = (q < many) & (n == own[np.minimum(q, many - 1)])
        found = np.bincount(q[~itself], minlength=len(asked))
        wanted = truth - np.bincount(q[itself], minlength=len(asked))
        kinds = (slice(0, many), slice(many, None))
        return min(float((found[k][wanted[k] > 0] / wanted[k][wanted[k] > 0]).mean()) if (wanted[k] > 0).any() else 1.0 for k in kinds)

    beam = BEAM
    while beam < min(WIDEST, len(base)) and recall(beam) < RECALL:
        beam *= 2
    return beam


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the groups of labels a and b (pairwise) are merged."""
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    if root:
        known, back = np.unique(label, return_inverse=True)
        label = np.array([find(int(x)) for x in known])[back]
    return label


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(uid, links) of nodes (uid, v, copies, root): the other rows linked to each, counted over the whole component.

    A component's nodes are dealt into blocks, and each pair of blocks is one tile of bounded size, so both ends of
    every link count it whichever found it.
    """

    def count(tile: pa.Table) -> pa.Table:
        side, copies, unit = tile.column("side").to_numpy(), tile.column("copies").to_numpy(), _normal(_matrix(tile.column("v")))
        one = side == side.min()
        links = np.zeros(len(side), dtype=np.int64)
        if one.all():
            for k in range(0, len(side), 256):
                near = unit[k : k + 256] @ unit.T >= threshold
                near[np.arange(len(near)), k + np.arange(len(near))] = False
                links[k : k + 256] = near @ copies
        else:
            first, second = np.flatnonzero(one), np.flatnonzero(~one)
            for k in range(0, len(first), 256):
                near = unit[first[k : k + 256]] @ unit[second].T >= threshold
                links[first[k : k + 256]] = near @ copies[second]
                links[second] += copies[first[k : k + 256]] @ near
        return pa.table({"uid": tile.column("uid"), "links": pa.array(links)}, schema=pa.schema([("uid", pa.int64()), ("links", pa.int64())]))

    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.expr("pmod(xxhash64(uid, 7), blocks)"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = met.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "uid", "copies", "v")
    return tiles.groupBy("root", "i", "j").applyInArrow(count, "uid long, links long").groupBy("uid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Two rows link when the cosine of their embeddings, in double precision, is at least ``threshold``; labels and
    other columns don't matter. n_links counts the other rows found linked, component_id is the smallest vec_id
    reachable, kept says whether that is the row's own. Embeddings that are null, empty, zero or hold null or
    non-finite components, and embeddings of different lengths, link with nothing. Rows without a vec_id aren't
    compared (0 links, no component, not kept). Rows that share a vec_id are rows of their own, but of one component
    where either links. Embeddings of any length are compared whole.

    Equal embeddings are one node with a count. Nodes are dealt over shards by hash; each shard's graph is built in
    one task and written to the shared folder, and its beam is widened until a recall audit against brute force
    passes. Every node then asks every shard, in slices; a query whose beam is full of links is repeated with a wider
    one. A task returns, per query, one edge for each of the shard's own components it reaches, never all pairs of a
    group. Inside the components links are counted by brute force in tiles, so a link that only one end found, or
    neither, counts for both. The cost is rows times shards; there are as many ``shards`` as the cluster runs tasks
    unless given or one would exceed ``SHARD_ROWS``.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _unit(vectors).alias("v"))
    good = rows.where("v is not null and vec_id is not null").withColumn("uid", F.xxhash64("v"))
    nodes = materialize(good.groupBy("uid", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")).withColumn("dim", F.size("v")), "nodes")
    many = nodes.count()
    shards = shards or max(1, min(max(spark.sparkContext.defaultParallelism, -(-many // SHARD_ROWS)), -(-many // 64)))
    kind = nodes.schema["v"].dataType.simpleString()
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))

    def build(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("uid").to_numpy())
        uid = part.column("uid").to_numpy()[order]
        base = _normal(_matrix(part.column("v"))[order])
        graph = Graph(base)
        beam = _audited_beam(graph, base, threshold)
        label = np.arange(len(base))
        for k in range(0, len(base), TOGETHER):
            q, n = _hits(graph, base, base[k : k + TOGETHER], threshold, beam)
            label = _united(label, label[q + k], label[n])
        data = graph.to_bytes(base=base, uid=uid, copies=part.column("copies").to_numpy()[order], label=label, beam=np.array([beam]))
        pieces = [data[k : k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES)]
        head = [part.column("dim")[0].as_py(), part.column("shard")[0].as_py()]
        return pa.table({"dim": [head[0]] * len(pieces), "shard": [head[1]] * len(pieces), "piece": list(range(len(pieces))), "data": pieces}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("piece", pa.int32()), ("data", pa.binary())]))

    graphs = materialize(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, piece int, data binary"), "graphs")
    slices = max(1, -(-many // SLICE_ROWS))
    each = F.sequence(F.lit(0), F.lit(slices - 1))
    stored = graphs.select("dim", "shard", F.explode(each).alias("slice"), F.lit(0).alias("kind"), "piece", F.lit(None).cast("long").alias("uid"), "data", F.lit(None).cast(kind).alias("v"))
    asked = nodes.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64(F.col("uid"), F.lit(1)), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), F.lit(0).alias("piece"), "uid", F.lit(None).cast("binary").alias("data"), "v")
    tasks = stored.union(asked).repartitionByRange(min(shards * slices, MOST_TASKS), "dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", "kind", "piece")
    out = pa.schema([("uid", pa.int64()), ("other", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, held, pieces, at = None, {}, [], None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("dim", "shard", "slice", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part, key = whole.slice(low, high - low), tuple(keys[low])
                if key[:3] != at:
                    at, graph, pieces = key[:3], None, []
                if key[3] == 0:
                    pieces += part.column("data").to_pylist()
                    continue
                if graph is None and pieces:
                    graph, held = Graph.from_bytes(b"".join(pieces), "base")
                    pieces = []
                if graph is None:  # a shard without rows of this length
                    continue
                uid, queries = part.column("uid").to_numpy(), _normal(_matrix(part.column("v")))
                for k in range(0, len(uid), TOGETHER):
                    own = uid[k : k + TOGETHER]
                    q, n = _hits(graph, held["base"], queries[k : k + TOGETHER], threshold, int(held["beam"][0]))
                    other = held["uid"][n] != own[q]
                    reached = np.unique(np.stack((q[other], held["label"][n[other]]), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(own[reached[:, 0]]), pa.array(held["uid"][reached[:, 1]])], schema=out)

    answers = materialize(tasks.mapInArrow(ask, "uid long, other long"), "answers")
    groups = components(answers, "uid", "other").withColumnRenamed("node", "uid").withColumnRenamed("component", "root")
    joined = materialize(nodes.select("uid", "v", "copies").join(groups, "uid"), "joined")
    known = nodes.select("uid", "copies", "first").join(_counted(joined, threshold), "uid", "left").join(joined.select("uid", "root"), "uid", "left")
    known = materialize(known.select("uid", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root")), "known")
    smallest = materialize(known.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    known = materialize(known.join(smallest, "root").select("uid", "n_links", "component_id"), "known")
    release(nodes, graphs, answers, joined, smallest)
    linked = good.select("vec_id", "uid").join(known, "uid").select("vec_id", "n_links", "component_id")
    rest = rows.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n WHERE reach.r < l.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT n, min(r) AS component_id FROM reach GROUP BY n) r ON r.n = e.vec_id
"""
