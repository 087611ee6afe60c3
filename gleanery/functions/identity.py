"""Identities: canonical JSON, hashes of specifications and id sets, and the hash of a value's derivation."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits kept of a SHA-256.
DIGITS = 16


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces, the same for the same content."""
    return _ENCODER.encode(value)


def _plain(value: Any) -> Any:
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, set | frozenset):
        return sorted(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), default=_plain)


def hash_spec(spec: Any) -> str:
    """Short digest of a specification; made on the driver, where JSON is canonical."""
    return hashlib.sha256(canonical_json(spec).encode()).hexdigest()[:DIGITS]


def recipe_spec(kind: str, part: str, operations: list[dict], from_part: str | None = None, inputs: Any = None) -> dict:
    """What identifies a recipe: everything but its name; absent operation fields are left out."""
    kept = [{k: v for k, v in operation.items() if v is not None or k in ("name", "kind", "version", "parameters")} for operation in operations]
    return {"kind": kind, "part": part, "from_part": from_part, "inputs": inputs, "operations": kept}


def derivation_hash(recipe_hash: str | None, source_hash: str | None = None) -> str | None:
    """The recipe's hash, or with an upstream the hash of both."""
    return recipe_hash if source_hash is None else hash_spec({"recipe": recipe_hash, "from": source_hash})


def derivation(recipe: Column, source: Column) -> Column:
    """``derivation_hash`` as a Column; hashes are hex, so their JSON needs no escapes."""
    both = F.concat(F.lit('{"from":"'), source, F.lit('","recipe":"'), recipe, F.lit('"}'))
    return F.when(source.isNull(), recipe).otherwise(F.substring(F.sha2(both, 256), 1, DIGITS))


def combined_source(sources: dict[str, str]) -> str | None:
    """Identity of several upstream parts: one alone is itself, several are hashed by part name."""
    held = {part: source for part, source in sources.items() if source is not None}
    if len(held) <= 1:
        return next(iter(held.values()), None)
    return hash_spec(held)


def ids_digest(df: DataFrame, id_col: str) -> DataFrame:
    """One row (count, ids_hash) for the set of ids: order and repeats don't matter.

    The digest is the hash of the sorted JSON array of ids, so it needs the ids together once; for sets too large
    for that ``ids_fingerprint`` is the distributed choice.
    """
    ids = F.array_sort(F.collect_set(F.col(id_col).cast("string")))
    text = F.concat(F.lit('["'), F.array_join(F.col("ids"), '","'), F.lit('"]'))
    one = df.agg(ids.alias("ids"))
    return one.select(F.size("ids").cast("long").alias("count"), F.substring(F.sha2(F.when(F.size("ids") > 0, text).otherwise("[]"), 256), 1, DIGITS).alias("ids_hash"))


#: Ids up to which a set is digested in one place.
DIGESTED = 1_000_000


def ids_record(df: DataFrame, id_col: str) -> dict:
    """count and ids_hash of a set of ids: the digest, or for large sets the distributed fingerprint."""
    sums = ids_fingerprint(df, id_col).first()
    if sums["count"] > DIGESTED:
        return {"count": sums["count"], "ids_hash": hash_spec({"count": sums["count"], "sums": sums["fingerprint"]})}
    return ids_digest(df, id_col).first().asDict()


def ids_fingerprint(df: DataFrame, id_col: str) -> DataFrame:
    """One row (count, fingerprint) for the set of ids, by sums of hashes: any size, partial aggregation only."""
    distinct = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    part = lambda k: F.sum(F.conv(F.substring(F.sha2(F.col("id"), 256), 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    return distinct.agg(F.count("*").alias("count"), F.concat_ws("-", part(0).cast("string"), part(1).cast("string")).alias("fingerprint"))
