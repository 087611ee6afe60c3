"""A project: a folder of tables and logs, resumable runs over it, and every question asked of it.

Tables are versioned Parquet under <path>/tables; small registries and logs are JSON under <path>/logs, on the same
file system. Values are never changed in place: a run appends, and what is current is decided when read.
"""

from __future__ import annotations

import json
import os
import time
import tomllib
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import raster
from gleanery.functions.identity import canonical_json, derivation, hash_spec, ids_record
from gleanery.functions.naming import wide_name
from gleanery.operators import filters as filter_ops
from gleanery.operators import groupfit, selection, stored, validate, wide
from gleanery.plans.recipes import ID, ORGANISM, Operation, Recipe, execute, framed, masks_as_rows, spec_changes
from gleanery.sources import files, tables

MASKS = "occurrence_id string, part string, rle_counts binary, rle_height int, rle_width int, area int, score double, info string, recipe_hash string, run_id long, from_part string, source_mask_hash string, created_at string"
METRICS = "metric_id long, run_id long, occurrence_id string, part string, metric_name string, value_json string, unit string, recipe_hash string, source_mask_hash string"
RUNS = "run_id long, kind string, name string, part string, subset string, recipe_hash string, recipe_json string, status string, context_json string, created_at string, finished_at string, n_processed long, n_skipped long, n_failed long"
POINTERS = "kind string, name string, part string, recipe_hash string, updated_at string"
FAILURES = "occurrence_id string, part string, stage string, context_hash string, error string, failed_at string"
CALIBRATIONS = "calibration_type string, scope string, scope_value string, parameters_json string, source string, score double, measured_from string, created_at string"


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Project:
    """One project of occurrences, images, masks and measurements."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Tables and logs ------------------------------------------------------------------------

    def at(self, name: str) -> str:
        return f"{self.path}/tables/{name}"

    def log(self, name: str) -> str:
        return f"{self.path}/logs/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        return tables.load_table(self.spark, self.at(name), missing_ok=True, schema=empty.schema)

    def occurrences(self) -> DataFrame:
        return tables.load_table(self.spark, self.at("occurrences"))

    def save_occurrences(self, df: DataFrame) -> None:
        tables.write_table(files.validate_ids(df, "occurrence table"), self.at("occurrences"))

    def images(self) -> DataFrame:
        return self._read("images", f"{ID} string, path string, bytes long, modified timestamp, height int, width int, channels int, data binary")

    def load_masks(self, parts: Sequence[str] | None = None, ids: DataFrame | None = None, recipe_hash: str | None = None, reference: bool = False) -> DataFrame:
        """Masks; part and recipe reach the scan, ids are a semi join."""
        df = self._read("reference_masks" if reference else "masks", MASKS)
        df = df.where(F.col("part").isin(list(parts))) if parts is not None else df
        df = df.where(F.col("recipe_hash") == recipe_hash) if recipe_hash else df
        return df.join(tables.shuffled(ids.select(ID)), ID, "left_semi") if ids is not None else df

    def load_runs(self, kind: str | None = None, name: str | None = None, recipe_hash: str | None = None) -> DataFrame:
        """Runs, newest first; the last state of each."""
        df = self._read("runs", RUNS)
        latest = df.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "run_id"]), F.coalesce("finished_at", "created_at")).alias("r")).select("run_id", "r.*")
        for column, value in (("kind", kind), ("name", name), ("recipe_hash", recipe_hash)):
            latest = latest.where(F.col(column) == value) if value is not None else latest
        return latest.orderBy(F.desc("run_id"))

    def load_metrics(self, run_names: Sequence[str] | None = None, parts: Sequence[str] | None = None, metric_names: Sequence[str] | None = None, ids: DataFrame | None = None, current_only: bool = False) -> DataFrame:
        """Long measurements with their run's name and kind; value is VARIANT. The small run table is joined, filters reach the scan."""
        df = self._read("metrics", METRICS)
        for column, wanted in (("part", parts), ("metric_name", metric_names)):
            df = df.where(F.col(column).isin(list(wanted))) if wanted is not None else df
        df = df.join(tables.shuffled(ids.select(ID)), ID, "left_semi") if ids is not None else df
        runs = self._read("runs", RUNS).groupBy("run_id").agg(F.max("name").alias("run_name"), F.max("kind").alias("run_kind"), F.min("created_at").alias("run_created_at"))
        runs = runs.where(F.col("run_name").isin(list(run_names))) if run_names is not None else runs
        df = df.join(runs, "run_id").withColumn("value", F.try_parse_json("value_json")).drop("value_json")
        return self.current(df) if current_only else df

    def current(self, long: DataFrame) -> DataFrame:
        both = self.load_masks().select(ID, "part", "recipe_hash", "source_mask_hash").union(self.load_masks(reference=True).select(ID, "part", "recipe_hash", "source_mask_hash"))
        pointers = self._read("pointers", POINTERS).where("kind = 'metric'").select("name", "part", "recipe_hash")
        return wide.current_rows(long, both, pointers)

    # Ingest -----------------------------------------------------------------------------------

    def ingest_occurrences(self, source: str | DataFrame, id_col: str | None = None, image_url_col: str | None = None, datetime_cols: Sequence[str] = (), numeric_cols: Sequence[str] = (), transform=None, drop: Mapping | None = None, dedupe_key_cols: Sequence[str] | None = None, dedupe_precision: Mapping[str, int] | None = None, dedupe_rule: str = "random", prefer: Mapping | None = None, group_col: str | None = None, max_per_group: int | None = None, cap_rule: str = "random") -> DataFrame:
        """Read, normalise, transform, drop, dedupe, cap and store, in this order; the same file with the same decisions is not read twice.

        Members of the stored table are kept first where a cap or dedupe chooses, so raising a cap only adds.
        """
        decisions = {"id_col": id_col, "image_url_col": image_url_col, "datetime_cols": list(datetime_cols), "numeric_cols": list(numeric_cols), "transform": _named(transform), "drop": _plain(drop), "dedupe": [list(dedupe_key_cols or ()), dict(dedupe_precision or {}), dedupe_rule], "prefer": _plain(prefer), "group_col": group_col, "max_per_group": max_per_group, "cap_rule": cap_rule}
        raw = None
        if isinstance(source, str):
            raw = files.archive_raw(source, f"{self.path}/raw", "occurrences")
            import_hash = hash_spec({"raw": raw, "decisions": decisions})
            if any(r.get("import_hash") == import_hash for r in tables.read_log(self.log("imports.jsonl"))) and tables.exists(self.spark, self.at("occurrences")):
                return self.occurrences()
            df = files.read_csv(self.spark, source)
        else:
            import_hash, df = None, source if files.POSITION in source.columns else files.with_position(source)
        df = files.normalize(df, id_col, image_url_col, datetime_cols, numeric_cols)
        stages = {"read": df.count()}
        for step in transform if isinstance(transform, list | tuple) else [transform] if transform else []:
            df = step(df)
        df = filter_ops.without_matching(df, drop)
        stages["kept"] = df.count()
        kept = self.occurrences().select(ID) if tables.exists(self.spark, self.at("occurrences")) else None
        order = ID
        if dedupe_key_cols:
            df = selection.dedupe_by(df, dedupe_key_cols, order, dedupe_precision, dedupe_rule, keep=kept, prefer=prefer)
            stages["deduplicated"] = df.count()
        if group_col and max_per_group is not None:
            df = selection.cap_per_group(df, group_col, max_per_group, order, cap_rule, keep=kept, prefer=prefer)
            stages["capped"] = df.count()
        self.save_occurrences(df)
        tables.append_jsonl(self.log("imports.jsonl"), {"import_hash": import_hash, "raw_hash": raw, "decisions": decisions, "stages": stages, "at": _now()})
        return self.occurrences()

    def ingest_darwincore(self, path: str, media_rule: str = "first", size: str | None = None, precision: int = 3, dedupe: bool = False, **options: Any) -> DataFrame:
        """An occurrence archive: one image per record, absences left out, optionally deduplicated by place and day."""
        os.makedirs(f"{self.path}/raw", exist_ok=True)
        found = files.locate_archive(path, f"{self.path}/raw")
        records = files.read_tsv(self.spark, found["occurrence"])
        if "multimedia" in found:
            media = files.select_media(files.read_tsv(self.spark, found["multimedia"]), media_rule)
            if size:
                media = media.withColumn("identifier", files.photo_size(F.col("identifier"), size))
            records = files.merge_media(records, media)
        extra = {"dedupe_key_cols": ["decimalLatitude", "decimalLongitude", "eventDate"], "dedupe_precision": {"decimalLatitude": precision, "decimalLongitude": precision}} if dedupe else {}
        return self.ingest_occurrences(records, id_col="gbifID", image_url_col="media_identifier", drop={"occurrenceStatus": "ABSENT"} if "occurrenceStatus" in records.columns else None, **extra, **options)

    def ingest_images(self, folder: str, metadata: DataFrame | None = None, patterns: str = "*.{png,jpg,jpeg,PNG,JPG,JPEG}", recursive: bool = False) -> DataFrame:
        """Images of a folder as occurrences named by their file stem, with metadata joined."""
        found = files.unique_stems(files.images(self.spark, folder, patterns, recursive))
        tables.write_table(found, self.at("images"))
        df = files.with_position(self.images().drop("data"))
        self.save_occurrences(df.join(metadata, ID, "left") if metadata is not None else df)
        return self.occurrences()

    def download_images(self, url_col: str = "image_url", limit: int | None = None, max_new: int | None = None, retry_failed: bool = False, fetch=None, decode=raster.read_png) -> dict:
        """Fetch what is pending; failures are remembered by address, successes become images."""
        failures = self._read("failures", FAILURES)
        todo = files.pending_downloads(self.occurrences(), self.images().select(ID), failures, url_col, limit, max_new, retry_failed)
        got = tables.written(files.download(todo, url_col, fetch=fetch).join(todo.select(ID, url_col), ID))

        def pixels(frames):
            import pandas as pd

            for pdf in frames:
                rows = []
                for r in pdf.itertuples(index=False):
                    try:
                        image = decode(r.content)
                        rows.append((r.occurrence_id, r.url, len(r.content), *image.shape[:2], 1 if image.ndim == 2 else image.shape[2], image.tobytes(), None))
                    except Exception as e:  # a file that is no image is that row's failure
                        rows.append((r.occurrence_id, r.url, len(r.content), None, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=[ID, "path", "bytes", "height", "width", "channels", "data", "error"]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

        decoded = tables.written(got.where("content is not null").select(ID, F.col(url_col).alias("url"), "content").mapInPandas(pixels, f"{ID} string, path string, bytes long, height int, width int, channels int, data binary, error string"))
        good = decoded.where("error is null").drop("error").withColumn("modified", F.current_timestamp())
        if not good.isEmpty():
            tables.upsert_table(self.images().limit(0).unionByName(good), self.at("images"), [ID])
        bad = got.where("content is null").select(ID, url_col, "error").union(decoded.where("error is not null").select(ID, "path", "error"))
        rows = bad.select(ID, F.lit("").alias("part"), F.lit("download").alias("stage"), F.substring(F.sha2(F.col(url_col), 256), 1, 16).alias("context_hash"), "error", F.lit(_now()).alias("failed_at"))
        self._remember(rows, good.select(ID), "download", "")
        return {"attempted": got.count(), "stored": good.count(), "failed": rows.count()}

    # Subsets ------------------------------------------------------------------------------------

    def load_subsets(self) -> dict[str, dict]:
        return tomllib.loads((tables.read_bytes(self.log("subsets.toml")) or b"").decode())

    def define_subset(self, name: str, column: str | None = None, values: Sequence | None = None, query: str | None = None, ids: Sequence[str] | DataFrame | None = None, from_subset: str | None = None, note: str | None = None) -> dict:
        """A named, persisted rule: values of a column, a query, frozen ids, or another subset's ids frozen now."""
        given = [values is not None, query is not None, ids is not None, from_subset is not None]
        if sum(given) != 1 or (values is not None) != (column is not None):
            raise ValueError("a subset is exactly one of column and values, query, ids, from_subset")
        if from_subset is not None:
            ids = self.select_ids(from_subset)
        rule: dict[str, Any] = {"note": note} if note else {}
        if ids is not None:
            frame = ids.select(F.col(ids.columns[0]).cast("string").alias(ID)) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], f"{ID} string")
            tables.write_table(frame.distinct(), self.at(f"subset_{name}"))
            one = ids_record(tables.load_table(self.spark, self.at(f"subset_{name}")), ID)
            rule |= {"ids": True, "count": one["count"], "ids_hash": one["ids_hash"]}
        elif query is not None:
            filter_ops.query_column(self.occurrences(), query)
            rule["query"] = query
        else:
            rule |= {"column": column, "values": [values] if isinstance(values, str) else list(values)}
        every = self.load_subsets() | {name: rule}
        text = "\n".join(f"[{json.dumps(n)}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in r.items()) for n, r in every.items())
        tables.write_bytes(self.log("subsets.toml"), text.encode())
        return rule

    def define_subsets(self, column: str, mapping: Mapping[str, Sequence], note: str | None = None) -> None:
        for name, values in mapping.items():
            self.define_subset(name, column=column, values=values, note=note)

    def select_occurrences(self, subset: str | None = None, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of a subset in source order; ``limit`` takes the first of them."""
        df = self.occurrences()
        if subset is not None:
            rule = self.load_subsets()[subset]
            if rule.get("ids"):
                df = df.join(tables.shuffled(tables.load_table(self.spark, self.at(f"subset_{subset}"))), ID, "left_semi")
            elif "query" in rule:
                df = df.where(filter_ops.query_column(df, rule["query"]))
            else:
                df = filter_ops.rows_matching(df, {rule["column"]: rule["values"]})
        if limit is not None:
            df = df.orderBy(files.POSITION if files.POSITION in df.columns else ID).limit(limit)
        return df.select(ID, *[c for c in columns if c != ID]) if columns else df

    def select_ids(self, subset: str | None = None, limit: int | None = None) -> DataFrame:
        return self.select_occurrences(subset, limit, [ID])

    def grow_subset(self, name: str, target: int, candidates: DataFrame | None = None, seed: int = selection.SEED) -> dict:
        """Grow or shrink a frozen subset toward a size, keeping its members."""
        keep = self.select_ids(name) if name in self.load_subsets() else None
        return self.define_subset(name, ids=tables.written(selection.grow(candidates or self.select_ids(), target, ID, keep, seed).select(ID)))

    # Calibrations ---------------------------------------------------------------------------------

    def calibrations(self, kind: str | None = None) -> DataFrame:
        df = self._read("calibrations", CALIBRATIONS)
        return df.where(F.col("calibration_type") == kind) if kind else df

    def save_calibrations(self, rows: Sequence[tuple[str, str, dict]], kind: str = "scale", source: str = "declared", measured_from: str | None = None) -> None:
        made = [(kind, scope, str(value), canonical_json(p), source, p.get("score"), measured_from, _now()) for scope, value, p in rows]
        tables.upsert_table(self.spark.createDataFrame(made, CALIBRATIONS), self.at("calibrations"), ["calibration_type", "scope", "scope_value"])

    def declare_scale(self, px_per_mm: float, scope: str = ID, scope_value: str | None = None, measured_from: str | None = None) -> None:
        """A known scale for one value of a column, or for all its values."""
        if not px_per_mm > 0:
            raise ValueError("a scale is positive")
        if scope_value is not None:
            self.save_calibrations([(scope, scope_value, {wide.SCALE: float(px_per_mm)})], measured_from=measured_from)
            return
        values = self.occurrences().select(F.col(scope).cast("string").alias("scope_value")).where("scope_value is not null").distinct()
        text = lambda value: F.lit(value).cast("string")
        made = values.select(text("scale").alias("calibration_type"), text(scope).alias("scope"), "scope_value", text(canonical_json({wide.SCALE: float(px_per_mm)})).alias("parameters_json"), text("declared").alias("source"), F.lit(None).cast("double").alias("score"), text(measured_from).alias("measured_from"), text(_now()).alias("created_at"))
        tables.upsert_table(tables.written(made), self.at("calibrations"), ["calibration_type", "scope", "scope_value"])

    def scale_for_occurrences(self) -> DataFrame:
        held = self.calibrations("scale").select("scope", "scope_value", F.get_json_object("parameters_json", f"$.{wide.SCALE}").cast("double").alias("parameters"))
        return wide.resolve_scope(self.occurrences(), held).select(ID, F.col("parameters").alias(wide.SCALE))

    def measure_scales(self, template, target_mm: float, scope: str = ID, region=None, match_score_min: float = 0.4, max_new: int | None = None) -> DataFrame:
        """The scale of every value of a column that has none, from a target in its first image."""
        pending = wide.pending_scope_values(self.occurrences(), self.calibrations("scale"), scope, max_new)
        text = F.col(scope).cast("string")
        firsts = self.occurrences().withColumn("scope_value", text).join(pending, "scope_value", "left_semi").join(self.images().select(ID), ID, "left_semi").groupBy("scope_value").agg(F.min(ID).alias(ID))
        work = firsts.join(self.images().select(ID, "height", "width", "channels", "data"), ID)

        def measure(frames):
            import numpy as np
            import pandas as pd

            for pdf in frames:
                out = []
                for r in pdf.itertuples(index=False):
                    image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
                    got = raster.scale_from_target(image[..., 0] if image.shape[2] == 1 else image[..., :3], template, target_mm, region, match_score_min=match_score_min)
                    if got:
                        out.append((r.scope_value, r.occurrence_id, canonical_json(got), got["score"]))
                yield pd.DataFrame(out, columns=["scope_value", ID, "parameters_json", "score"])

        found = work.mapInPandas(measure, f"scope_value string, {ID} string, parameters_json string, score double")
        rows = tables.written(found.select(F.lit("scale").alias("calibration_type"), F.lit(scope).alias("scope"), "scope_value", "parameters_json", F.lit("measured").alias("source"), "score", F.col(ID).alias("measured_from"), F.lit(_now()).alias("created_at")))
        if not rows.isEmpty():
            tables.upsert_table(rows, self.at("calibrations"), ["calibration_type", "scope", "scope_value"])
        return rows

    # Runs --------------------------------------------------------------------------------------------

    def _start(self, recipe: Recipe, subset: str | None) -> int:
        run_id = max(int(time.time() * 1000), (self._read("runs", RUNS).agg(F.max("run_id")).first()[0] or 0) + 1)
        while not tables.claim(f"{self.path}/logs/run_ids/{run_id}"):  # another driver's
            run_id += 1
        row = (run_id, recipe.kind, recipe.name, recipe.part, subset, recipe.hash, canonical_json(recipe.spec()), "running", None, _now(), None, None, None, None)
        tables.append_table(self.spark.createDataFrame([row], RUNS), self.at("runs"))
        return run_id

    def _finish(self, run_id: int, recipe: Recipe, subset: str | None, counts: dict[str, int]) -> None:
        row = (run_id, recipe.kind, recipe.name, recipe.part, subset, recipe.hash, canonical_json(recipe.spec()), "finished", None, _now(), _now(), counts.get("done", 0), counts.get("skipped", 0), counts.get("failed", 0))
        tables.append_table(self.spark.createDataFrame([row], RUNS), self.at("runs"))
        tables.append_jsonl(self.log("runs.jsonl"), dict(zip([c.split()[0] for c in RUNS.split(", ")], row, strict=True)))

    def _pin(self, recipe: Recipe, force: bool) -> None:
        """A run name belongs to one recipe; another one raises unless forced, and then hides the older values."""
        held = self._read("pointers", POINTERS).where((F.col("kind") == recipe.kind) & (F.col("name") == recipe.name) & (F.col("part") == recipe.part)).first()
        if held and held["recipe_hash"] != recipe.hash and not force:
            old = self.load_runs(recipe.kind, recipe.name, held["recipe_hash"]).first()
            raise ValueError(f"run {recipe.name!r} has another recipe: {spec_changes(json.loads(old['recipe_json']), recipe.spec()) if old else held['recipe_hash']}; force to move it")
        if not held or held["recipe_hash"] != recipe.hash:
            tables.upsert_table(self.spark.createDataFrame([(recipe.kind, recipe.name, recipe.part, recipe.hash, _now())], POINTERS), self.at("pointers"), ["kind", "name", "part"])

    def _remember(self, failed: DataFrame, succeeded: DataFrame, stage: str, part: str) -> None:
        """Failures of a stage by the context they happened in; a success clears them."""
        old = self._read("failures", FAILURES)
        mine = (F.col("stage") == stage) & (F.col("part") == part)
        cleared = old.where(mine).join(tables.shuffled(succeeded.select(ID)), ID, "left_anti").join(tables.shuffled(failed.select(ID)), ID, "left_anti")
        tables.write_table(old.where(~mine).unionByName(cleared).unionByName(failed.select(*old.columns)), self.at("failures"))

    def _sources(self, part: str | Sequence[str], reference: bool) -> DataFrame:
        """(occurrence_id, masks, source_mask_hash) where every upstream part has a mask."""
        parts = [part] if isinstance(part, str) else sorted(part)
        held = self.load_masks(parts, reference=reference).withColumn("_d", derivation(F.col("recipe_hash"), F.col("source_mask_hash")))
        packed = held.groupBy(ID).agg(F.collect_list(F.struct("rle_counts", "rle_height", "rle_width")).alias("masks"), F.array_sort(F.collect_list(F.struct("part", "_d"))).alias("_p"))
        whole = packed.where(F.size("_p") == len(parts))
        pairs = F.array_join(F.transform("_p", lambda x: F.concat(F.lit('"'), x["part"], F.lit('":"'), x["_d"], F.lit('"'))), ",")
        many = F.substring(F.sha2(F.concat(F.lit("{"), pairs, F.lit("}")), 256), 1, 16)
        return whole.select(ID, "masks", F.when(F.size("_p") == 1, F.get("_p", 0)["_d"]).otherwise(many).alias("source_mask_hash"))

    def run_segments(self, steps: Sequence[Operation], run_name: str, part: str = ORGANISM, from_part: str | Sequence[str] | None = None, subset: str | None = None, limit: int | None = None, force: bool | None = None, reference: bool = False, shard: tuple[int, int] | None = None, retry_failed: bool = False) -> dict:
        """Masks for occurrences that this recipe has not segmented yet: pending = selected - done - failed in this context, by anti joins before any image is read."""
        recipe = Recipe("segment", run_name, list(steps), part, from_part if from_part is None or isinstance(from_part, str) else sorted(from_part), {"masks": "reference"} if reference and from_part else {})
        if recipe.unrepeatable() and force is None:
            raise ValueError("a step can't be repeated: say with force whether finished work is redone")
        self._pin(recipe, bool(force))
        ids = self.select_ids(subset, limit)
        ids = selection.shard(ids, ID, *shard) if shard else ids
        work = tables.shuffled(ids).join(self.images().select(ID, "height", "width", "data"), ID)
        if from_part is not None:
            work = work.join(tables.shuffled(self._sources(from_part, reference)), ID)
        else:
            work = work.withColumn("masks", F.lit(None).cast("array<struct<rle_counts:binary,rle_height:int,rle_width:int>>")).withColumn("source_mask_hash", F.lit(None).cast("string"))
        done = self.load_masks([part], recipe_hash=recipe.hash, reference=reference).select(F.col(ID).alias("_id"), F.col("source_mask_hash").alias("_s"))
        todo = work if force else work.join(tables.shuffled(done), (work[ID] == done["_id"]) & work["source_mask_hash"].eqNullSafe(done["_s"]), "left_anti")
        context = hash_spec({"recipe": recipe.hash})
        if not retry_failed:
            bad = self._read("failures", FAILURES).where((F.col("stage") == "segment") & (F.col("part") == part) & (F.col("context_hash") == context)).select(ID)
            todo = todo.join(tables.shuffled(bad), ID, "left_anti")
        run_id = self._start(recipe, subset)
        results = tables.written(execute(todo, recipe, ["source_mask_hash"]))
        masks = masks_as_rows(results, recipe, run_id)
        if not masks.isEmpty():
            tables.upsert_table(masks, self.at("reference_masks" if reference else "masks"), [ID, "part"])
        counts = {r["status"]: r["count"] for r in results.groupBy("status").count().collect()}
        self._after(results, "segment", part, context)
        counts["skipped"] = ids.count() - sum(counts.values())
        self._finish(run_id, recipe, subset, counts)
        return counts | {"run_id": run_id, "recipe_hash": recipe.hash}

    def _after(self, results: DataFrame, stage: str, part: str, context: str) -> None:
        failed = results.where("status = 'failed'").groupBy(ID).agg(F.min("error").alias("error")).select(ID, F.lit(part).alias("part"), F.lit(stage).alias("stage"), F.lit(context).alias("context_hash"), "error", F.lit(_now()).alias("failed_at"))
        self._remember(failed, results.where("status = 'done'").select(ID).distinct(), stage, part)

    def run_metrics(self, metrics: Sequence[Operation], run_name: str, transforms: Sequence[Operation] = (), part: str = ORGANISM, subset: str | None = None, limit: int | None = None, force: bool = False, reference: bool = False, retry_failed: bool = False) -> dict:
        """Measure what this recipe has not measured over these masks: done here is skipped, done under another name is copied, the rest is run."""
        recipe = Recipe("metric", run_name, [*transforms, *metrics], part, None, {"masks": "reference"} if reference else {})
        self._pin(recipe, force)
        ids = self.select_ids(subset, limit)
        sources = tables.written(ids.join(tables.shuffled(self._sources(part, reference)), ID))
        stored = self.load_metrics(parts=[part]).where(F.col("recipe_hash") == recipe.hash)
        known = stored.select(F.col(ID).alias("_id"), F.col("source_mask_hash").alias("_s"), "run_name").distinct()
        same = (sources[ID] == known["_id"]) & (sources["source_mask_hash"] == known["_s"])
        todo = sources if force else sources.join(tables.shuffled(known.where(F.col("run_name") == run_name)), same, "left_anti")
        context = hash_spec({"recipe": recipe.hash})
        if not retry_failed:
            bad = self._read("failures", FAILURES).where((F.col("stage") == "metric") & (F.col("part") == part) & (F.col("context_hash") == context)).select(ID)
            todo = todo.join(tables.shuffled(bad), ID, "left_anti")
        todo = tables.written(todo)
        other = stored.where(F.col("run_name") != run_name).join(tables.shuffled(todo.select(F.col(ID).alias("_id"), F.col("source_mask_hash").alias("_s"))), (F.col(ID) == F.col("_id")) & (F.col("source_mask_hash") == F.col("_s")), "left_semi")
        newest = tables.written(other.withColumn("_new", F.max("run_id").over(Window.partitionBy(ID))).where("run_id = _new").select(ID, "part", "metric_name", F.to_json("value").alias("value_json"), "unit", "source_mask_hash"))
        fresh = todo.join(tables.shuffled(newest.select(ID).distinct()), ID, "left_anti") if not force else todo
        work = tables.shuffled(fresh).join(self.images().select(ID, "height", "width", "data"), ID)
        run_id = self._start(recipe, subset)
        results = tables.written(execute(work, recipe, ["source_mask_hash"]))
        rows = results.where("status = 'done'").select(ID, "part", "metric_name", "value_json", "unit", "source_mask_hash")
        self.append_metrics(rows if force else rows.union(newest), run_id, recipe.hash)
        counts = {r["status"]: r["n"] for r in results.groupBy("status").agg(F.count_distinct(ID).alias("n")).collect()}
        self._after(results, "metric", part, context)
        counts |= {"copied": newest.select(ID).distinct().count()}
        counts["skipped"] = sources.count() - todo.count()
        self._finish(run_id, recipe, subset, counts)
        return counts | {"run_id": run_id, "recipe_hash": recipe.hash}

    def append_metrics(self, rows: DataFrame, run_id: int, recipe_hash: str) -> None:
        """Append values; metric_id rises with the run and is unique: the newest value of a cell is that of the largest."""
        top = self._read("metrics", METRICS).agg(F.max("metric_id")).first()[0] or 0
        numbered = selection.global_rank(rows, [ID, "metric_name"], "_n")
        out = numbered.select((F.lit(top + 1) + F.col("_n")).alias("metric_id"), F.lit(run_id).cast("long").alias("run_id"), ID, "part", "metric_name", "value_json", "unit", F.lit(recipe_hash).alias("recipe_hash"), "source_mask_hash")
        tables.append_table(out, self.at("metrics"))

    def store_values(self, values: DataFrame, run_name: str, metric_name: str, part: str = ORGANISM, unit: str | None = None, kind: str = "metric", identity: Any = None) -> int:
        """Values computed elsewhere (labels, clusters, scores) as a run: ``values`` has occurrence_id and value (any type)."""
        recipe = Recipe(kind, run_name, [Operation(metric_name, _stored, "metric", {"identity": identity} if identity is not None else {}, metric_name=metric_name, unit=unit)], part)
        self._pin(recipe, True)
        run_id = self._start(recipe, None)
        type_ = values.schema["value"].dataType.typeName()
        text = F.to_json(F.struct(F.col("value").alias("v"))) if type_ not in ("struct", "map", "array") else F.to_json("value")
        value = F.regexp_extract(text, r'^\{"v":(.*)\}$', 1) if type_ not in ("struct", "map", "array") else text
        rows = values.where("value is not null").select(F.col(ID).cast("string").alias(ID), F.lit(part).alias("part"), F.lit(metric_name).alias("metric_name"), value.alias("value_json"), F.lit(unit).cast("string").alias("unit"), F.lit(None).cast("string").alias("source_mask_hash"))
        self.append_metrics(rows, run_id, recipe.hash)
        self._finish(run_id, recipe, None, {"done": rows.count()})
        return run_id

    # Reading -----------------------------------------------------------------------------------------

    def metrics_wide(self, run_names=None, parts=None, metric_names=None, current_only: bool = True, transform_info: bool = False) -> DataFrame:
        return wide.wide(self.load_metrics(run_names, parts, metric_names, current_only=current_only), transform_info or metric_names is not None)

    def filtered_wide(self, run_names=None, parts=None, metric_names=None, filters: Mapping | None = None, subset: str | None = None, drop_empty: bool = True, current_only: bool = True, units: str | None = None, transform_info: bool = False, occurrence_columns: Sequence[str] | None = None) -> wide.Export:
        if units not in (None, "mm"):
            raise ValueError("units is None or 'mm'")
        long = self.load_metrics(run_names, parts, metric_names, current_only=current_only)
        more = None
        if filters and (run_names or parts or metric_names):
            names = {r[0] for r in self.load_runs("metric").select("name").distinct().collect()}
            wanted = [n for n in names if any(c.startswith(f"{n}__") for c in filters)]
            more = self.load_metrics(wanted, current_only=current_only) if wanted else None
        scale = self.scale_for_occurrences() if units == "mm" else None
        if scale is not None and scale.where(F.col(wide.SCALE).isNotNull()).isEmpty():
            raise ValueError("no scale covers these occurrences")
        occurrences = self.select_occurrences(subset, columns=occurrence_columns)
        return wide.filtered_wide(occurrences.drop(files.POSITION), long, filters, more, scale, drop_empty, transform_info or metric_names is not None)

    def export_metrics(self, path: str | None = None, run_names=None, parts=None, metric_names=None, filters: Mapping | None = None, part_filters: Mapping[str, Mapping] | None = None, occurrence_columns: Sequence[str] | None = None, subset: str | None = None, drop_empty: bool = True, current_only: bool = True, units: str | None = None, rename: Mapping[str, str] | None = None, transform_info: bool = False) -> DataFrame:
        """One row per occurrence: id, metadata, metric columns by name; converted, filtered, failing parts blanked, renamed, written as CSV with a manifest."""
        made = self.filtered_wide(run_names, parts, metric_names, filters, subset, drop_empty, current_only, units, transform_info, occurrence_columns)
        df, metric_columns = made.df, [c for c in made.metric_columns if c in made.df.columns]
        counts = None
        if part_filters:
            of_part = {p: [c for c in metric_columns if c.split("__")[1] == p] for p in part_filters}
            df, counts = wide.blank_failing_parts(df, part_filters, of_part)
            if drop_empty and metric_columns:
                df = df.where(F.coalesce(*[F.when(wide.present(df, c), F.lit(True)) for c in metric_columns]))
        metadata = [c for c in df.columns if c not in metric_columns and c not in made.hidden and c != ID]
        df = df.select(ID, *metadata, *metric_columns)
        if rename:
            if ID in rename or set(rename) - set(df.columns) or len({rename.get(c, c) for c in df.columns}) < len(df.columns):
                raise ValueError("a rename may not touch the id, name absent columns or make names equal")
            df = df.withColumnsRenamed(dict(rename))
        if path:
            flat = df.select(*[F.to_json(f"`{c}`").alias(c) if t.startswith(("variant", "array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])
            flat.write.mode("overwrite").option("header", True).csv(path)
            one = ids_record(df, ID)
            record = {"at": _now(), "path": path, "n_rows": one["count"], "ids_hash": one["ids_hash"], "columns": made.provenance, "filters": _plain(filters), "part_filters": _plain(part_filters), "part_counts": counts.first().asDict() if counts is not None else None, "selection": {"run_names": run_names, "parts": parts, "metric_names": metric_names, "subset": subset, "units": units}, "rename": dict(rename or {})}
            record["export_hash"] = hash_spec({k: v for k, v in record.items() if k not in ("at", "path")})
            tables.append_jsonl(self.log("exports.jsonl"), record)
        return df

    def export_units(self, run_names=None) -> dict[str, str | None]:
        found = wide.column_provenance(wide.cells(self.load_metrics(run_names, current_only=True)))
        return {r["column"]: r["unit"] for r in found.collect()}

    def load_exports(self) -> list[dict]:
        return tables.read_log(self.log("exports.jsonl"))

    def load_imports(self) -> list[dict]:
        return tables.read_log(self.log("imports.jsonl"))

    def latest_values(self, run_name: str, part: str = ORGANISM, metric_name: str | None = None, current_only: bool = True) -> DataFrame:
        return wide.latest_values(self.load_metrics([run_name], [part], [metric_name] if metric_name else None, current_only=current_only))

    # Selections over results --------------------------------------------------------------------------

    def ids_with_image(self) -> DataFrame:
        return self.images().select(ID).distinct().orderBy(ID)

    def ids_with_mask(self, part: str = ORGANISM, reference: bool = False) -> DataFrame:
        return self.load_masks([part], reference=reference).select(ID).distinct().orderBy(ID)

    def ids_matching(self, run_name: str, rules: Mapping, part: str = ORGANISM, current_only: bool = False) -> DataFrame:
        """Ids whose values of one run match any rule {metric or metric__key: values}."""
        flat = self.metrics_wide([run_name], [part], current_only=current_only)
        named = flat.select(ID, *[wide.typed(F.col(f"`{wide_name(run_name, part, c)}`"), "string" if any(isinstance(v, str) for v in filter_ops._listed(vs)) else "double").alias(c) for c, vs in rules.items()])
        return filter_ops.rows_matching(named, rules).select(ID).orderBy(ID)

    def ids_passing(self, filters: Mapping, run_names=None, parts=None, subset: str | None = None, units: str | None = None, current_only: bool = True) -> DataFrame:
        return self.filtered_wide(run_names, parts, None, filters, subset, units=units, current_only=current_only).df.select(ID).orderBy(ID)

    def ids_completed(self, run_name: str, part: str = ORGANISM, kind: str = "metric", reference: bool = False) -> DataFrame:
        """Occurrences that a run has finished and whose result is current."""
        if kind == "segment":
            hashes = self.load_runs("segment", run_name).select("recipe_hash").distinct()
            done = self.load_masks([part], reference=reference).join(hashes, "recipe_hash", "left_semi").select(ID)
        else:
            done = self.load_metrics([run_name], [part], current_only=True).select(ID)
        return self.select_ids().join(done, ID, "left_semi").distinct().orderBy(ID)

    def exemplars_per_group(self, run_name: str, group_col: str, metric_name: str, part: str = ORGANISM, count: int = 1, normalize: bool = True) -> DataFrame:
        """The most central occurrences of each group by a stored vector."""
        vectors = self.latest_values(run_name, part, metric_name).select(ID, stored.feature_vector(F.col("value")).alias("v")).where("v is not null")
        vectors = stored.same_length(vectors, "v").where("v is not null")
        rows = vectors.join(self.occurrences().select(ID, group_col), ID)
        return selection.medoids(rows, ID, "v", group_col, count, normalize)

    def split_ids(self, fractions: Mapping | None = None, stratify_col: str | None = None, group_col: str | None = None, subset: str | None = None, seed: int = 0) -> DataFrame:
        return selection.split(self.select_occurrences(subset), ID, fractions, group_col, stratify_col, seed).select(ID, "split")

    # Validation ----------------------------------------------------------------------------------------

    def _labelled(self, annotation_run: str, label_metric: str, part: str = ORGANISM, subset: str | None = None) -> DataFrame:
        label = self.latest_values(annotation_run, part, label_metric).select(ID, wide.typed(F.col("value"), "string").alias("label"))
        flat = self.metrics_wide()
        numbers = flat.select(ID, *[wide.typed(F.col(f"`{c}`"), "double").alias(c) for c in flat.columns[1:]])
        return numbers.join(label, ID).join(self.select_ids(subset), ID, "left_semi")

    def get_validated_filters(self, specs: Mapping[str, str], annotation_run: str, label_metric: str, part: str = ORGANISM, subset: str | None = None, audit_subset: str | None = None, **how: Any) -> dict[str, tuple]:
        """Filters calibrated on labels of a subset; an audit subset may share no occurrence with it."""
        if audit_subset and not validate.disjoint(self.select_ids(subset), self.select_ids(audit_subset), ID):
            raise ValueError("the calibration and the audit share occurrences")
        return validate.validated_filters(tables.written(self._labelled(annotation_run, label_metric, part, subset)), specs, "label", **how)

    def audit_filters(self, filters: Mapping, annotation_run: str, label_metric: str, part: str = ORGANISM, bad_labels=None, good_labels=None, subset: str | None = None) -> dict:
        """Rates of a filter set on labels with intervals, each filter's share, and whether there are enough labels to say so."""
        labelled = tables.written(self._labelled(annotation_run, label_metric, part, subset))
        bad = validate.bad_values(labelled, "label", bad_labels, good_labels)
        out = validate.score_filters(labelled, filters, "label", bad).first().asDict()
        out["filters"] = [r.asDict() for r in validate.filter_shares(labelled, filters, "label", bad).collect()] if filters else []
        return out | {"enough": out["n"] >= validate.AUDIT_ROWS and out["n_bad"] >= validate.AUDIT_BAD}

    def compare_metrics(self, predicted_run: str, reference_run: str, metric_name: str, part: str = ORGANISM) -> dict:
        number = lambda run, name: self.latest_values(run, part, metric_name).select(ID, wide.typed(F.col("value"), "double").alias(name))
        return validate.agreement(number(predicted_run, "predicted").join(number(reference_run, "reference"), ID), "predicted", "reference").first().asDict()

    def validate_masks(self, part: str = ORGANISM, reference_part: str | None = None, metric: str = "iou") -> DataFrame:
        """(occurrence_id, score) of canonical against reference masks."""
        from gleanery.functions.rle import decode

        pick = lambda df, p: df.select(ID, F.struct("rle_counts", "rle_height", "rle_width").alias(p))
        both = tables.shuffled(pick(self.load_masks([part]), "m")).join(pick(self.load_masks([reference_part or part], reference=True), "r"), ID)

        @F.pandas_udf("double")
        def score(m, r):
            import pandas as pd

            one = {"iou": raster.iou, "coverage": raster.coverage}[metric]
            masks = lambda d: [decode(bytes(c), h, w) for c, h, w in zip(d["rle_counts"], d["rle_height"], d["rle_width"], strict=True)]
            return pd.Series([one(a, b) for a, b in zip(masks(m), masks(r), strict=True)])

        return both.select(ID, score("m", "r").alias("score"))

    # Masks and training data in and out ------------------------------------------------------------------

    def import_masks(self, folder: str, part: str = ORGANISM, run_name: str = "imported", reference: bool = False, replace: bool = True) -> int:
        """Mask images (id or id__part) as masks: brighter than 127 is mask, the shape must be the image's; unchanged ones are skipped."""
        from gleanery.functions.rle import encode, mask_digest

        found = files.mask_files(files.images(self.spark, folder), self.images().select(ID), part)
        sized = tables.shuffled(found).join(self.images().select(ID, F.col("height").alias("ih"), F.col("width").alias("iw")), ID)

        def rows(frames):
            import numpy as np
            import pandas as pd

            for pdf in frames:
                out = []
                for r in pdf.itertuples(index=False):
                    if (r.height, r.width) != (r.ih, r.iw):
                        raise ValueError(f"the mask of {r.occurrence_id} has another shape than its image")
                    mask = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[..., 0] > 127
                    counts, h, w = encode(mask)
                    out.append((r.occurrence_id, r.part, counts, h, w, int(mask.sum()), hash_spec({"imported": mask_digest(mask)})))
                yield pd.DataFrame(out, columns=[ID, "part", "rle_counts", "rle_height", "rle_width", "area", "recipe_hash"]).astype({"rle_height": "int32", "rle_width": "int32", "area": "int32"})

        masks = tables.written(sized.mapInPandas(rows, f"{ID} string, part string, rle_counts binary, rle_height int, rle_width int, area int, recipe_hash string"))
        held = self.load_masks(reference=reference).select(ID, "part", F.col("recipe_hash").alias("_h"))
        new = masks.join(tables.shuffled(held), [ID, "part"], "left").where("_h is null or _h <> recipe_hash" if replace else "_h is null").drop("_h")
        recipe = Recipe("segment", run_name, [], part)
        run_id = self._start(recipe, None)
        none = F.lit(None).cast("string")
        full = new.select(ID, "part", "rle_counts", "rle_height", "rle_width", "area", F.lit(None).cast("double").alias("score"), none.alias("info"), "recipe_hash", F.lit(run_id).cast("long").alias("run_id"), none.alias("from_part"), none.alias("source_mask_hash"), F.lit(_now()).alias("created_at"))
        full = tables.written(full)
        n = full.count()
        if n:
            tables.upsert_table(full, self.at("reference_masks" if reference else "masks"), [ID, "part"])
        self._finish(run_id, recipe, None, {"done": n})
        return n

    def export_masks(self, folder: str, parts: Sequence[str] | None = None, subset: str | None = None, reference: bool = False) -> int:
        """0/255 PNGs named id__part, after all names are checked."""
        from gleanery.functions.rle import decode

        masks = self.load_masks(parts, self.select_ids(subset) if subset else None, reference=reference)
        named = masks.withColumn("name", F.concat_ws("__", ID, "part"))
        clash = [r[0] for r in named.groupBy(F.lower("name").alias("n")).agg(F.count_distinct("name").alias("k")).where("k > 1").limit(5).collect()]
        if clash or not named.where(F.col("name").rlike(r'[<>:"/\\|?*\x00-\x1f]')).isEmpty():
            raise ValueError(f"masks whose names no folder can hold: {clash}")

        @F.pandas_udf("binary")
        def pixels(counts, h, w):
            import pandas as pd

            return pd.Series([(decode(bytes(c), a, b) * 255).astype("uint8").tobytes() for c, a, b in zip(counts, h, w, strict=True)])

        return files.write_images(named.withColumn("px", pixels("rle_counts", "rle_height", "rle_width")), "name", "rle_height", "rle_width", "px", folder)

    def export_training_data(self, folder: str, class_by: str | None = None, splits: DataFrame | None = None, part: str = ORGANISM, subset: str | None = None, reference: bool = False) -> DataFrame:
        """Images as split/class/id.png with a manifest; without a class, or in two splits, none is written."""
        df = self.select_occurrences(subset).join(tables.shuffled(self.load_masks([part], reference=reference).select(ID)), ID, "left_semi")
        sides = splits if splits is not None else df.select(ID, F.lit("all").alias("split"))
        if not sides.groupBy(ID).agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
            raise ValueError("an occurrence is in two splits")
        df = df.join(tables.shuffled(sides), ID)
        if class_by:
            df = df.where(F.trim(F.col(class_by).cast("string")) != "")
        folder_of = F.concat_ws("/", "split", F.regexp_replace(F.col(class_by).cast("string"), r'[<>:"/\\|?*\s]+', "_") if class_by else F.lit("images"), ID)
        manifest = df.select(ID, "split", *([class_by] if class_by else []), folder_of.alias("file"))
        files.write_images(tables.shuffled(manifest).join(self.images().select(ID, "height", "width", "data"), ID), "file", "height", "width", "data", folder)
        manifest.write.mode("overwrite").option("header", True).csv(f"{folder}/manifest")
        tables.write_json(f"{folder}/dataset.json", {"at": _now(), "part": part, "class_by": class_by, "n": manifest.count()})
        return manifest

    def balanced_training_data(self, label_col: str, group_col: str | None = None, min_per_label: int = 10, max_per_label: int | None = None, fractions: Mapping | None = None) -> DataFrame:
        """(occurrence_id, label, split): capped per label, rare labels out, split by group, labels kept only where train and val both have them."""
        df = self.occurrences().where(F.trim(F.col(label_col).cast("string")) != "").join(self.load_masks().select(ID).distinct(), ID, "left_semi")
        df = selection.cap_per_group(df, label_col, max_per_label, ID) if max_per_label else df
        common = df.groupBy(label_col).count().where(F.col("count") >= min_per_label).select(label_col)
        done = tables.written(selection.split(df.join(common, label_col, "left_semi"), ID, fractions, group_col, label_col).select(ID, label_col, "split"))
        both = done.groupBy(label_col).agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v")).where("t > 0 and v > 0").select(label_col)
        return done.join(both, label_col, "left_semi")

    # Models fitted on stored values and pooled pixels ------------------------------------------------------

    def features(self, run_name: str, metrics: Sequence[str], part: str = ORGANISM, group_col: str | None = None) -> DataFrame:
        """(occurrence_id, group, one DOUBLE column per metric or metric__key) of a run's current values."""
        flat = self.metrics_wide([run_name], [part])
        named = flat.select(ID, *[wide.typed(F.col(f"`{wide_name(run_name, part, m)}`"), "double").alias(m) for m in metrics])
        return named.join(self.occurrences().select(ID, group_col), ID) if group_col else named

    def fit_metric(self, kind: str, features: Sequence[str], from_run: str, run_name: str, part: str = ORGANISM, group_col: str | None = None, labels_run: str | None = None, label_metric: str | None = None, bad_labels: Sequence | None = None, **how: Any) -> DataFrame:
        """Fit and store cluster, outlier or label_score over a run's values: groups apart, small ones with the population's model.

        The stored run's recipe holds the population it was fitted on and the recipe of the values, so it is another
        recipe once either changes.
        """
        table = tables.written(self.features(from_run, features, part, group_col))
        if kind == "cluster":
            scored = groupfit.cluster(table, features, ID, group_col, **how).select(ID, F.struct("cluster_id", "centroid_distance", "group").alias("value"))
        elif kind == "outlier":
            scored = groupfit.outlier(table, features, ID, group_col, **how).select(ID, F.struct("is_outlier", "anomaly_score", "group").alias("value"))
        elif kind == "label_score":
            labels = self.latest_values(labels_run, part, label_metric).select(ID, wide.typed(F.col("value"), "string").alias("label"))
            scored = groupfit.label_score(table, features, ID, labels, "label", bad_labels or [], **how)[0].select(ID, F.col("score").alias("value"))
        else:
            raise ValueError("kind is cluster, outlier or label_score")
        scored = tables.written(scored)
        source = self.load_runs("metric", from_run).first()
        population = ids_record(table, ID)
        self.store_values(scored, run_name, kind, part, identity={"features": list(features), "from_recipe": source["recipe_hash"], "population": population["ids_hash"], "group_col": group_col, "how": _plain(how), "bad": _plain(bad_labels)})
        return scored

    def pooled_pixels(self, part: str = ORGANISM, group_col: str | None = None, per_occurrence: int | None = groupfit.PIXELS, reference: bool = False) -> DataFrame:
        """(occurrence_id, group, pixels): at most so many masked BGR pixels of each occurrence, drawn with a fixed seed; all with None."""
        work = self.images().select(ID, "height", "width", "data").join(tables.shuffled(self._sources(part, reference)), ID)
        work = work.join(tables.shuffled(self.occurrences().select(ID, F.col(group_col).cast("string").alias("group"))), ID) if group_col else work.withColumn("group", F.lit(None).cast("string"))

        def draw(frames):
            import pandas as pd

            for pdf in frames:
                out = []
                for row in pdf.itertuples(index=False):
                    try:
                        out.append((row.occurrence_id, row.group, raster.masked_pixels(framed(row), per_occurrence).astype("uint8").tobytes()))
                    except ValueError:
                        continue  # an empty mask has no pixels to pool
                yield pd.DataFrame(out, columns=[ID, "group", "pixels"])

        return work.mapInPandas(draw, f"{ID} string, group string, pixels binary")

    def pixel_metric(self, kind: str, run_name: str, part: str = ORGANISM, group_col: str | None = None, min_group_size: int = 5, max_occurrences: int | None = None, **how: Any) -> DataFrame:
        """Fit a shared palette (color_clusters) or hue ranges (inductive_color_thresholds) per group on pooled pixels, and store every occurrence's shares.

        A fit pools the drawn pixels of all of a group's occurrences, or of ``max_occurrences`` drawn by a hash of the
        id. Palettes are scored on the drawn pixels, hue ranges on every masked pixel.
        """
        import numpy as np
        import pandas as pd

        pixels = tables.written(self.pooled_pixels(part, group_col))
        sizes = pixels.groupBy("group").count().where(F.col("group").isNotNull() & (F.col("count") >= min_group_size)).select("group")
        every = pixels.join(sizes, "group", "left_semi").select("group", ID, "pixels").union(pixels.select(F.lit(groupfit.POPULATION), ID, "pixels"))
        picked = selection.cap_per_group(every, "group", max_occurrences, ID) if max_occurrences is not None else every
        fit = {"color_clusters": groupfit.palette, "inductive_color_thresholds": groupfit.hue_definition}[kind]

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("colour")
            model = fit(groupfit.colour_pixels(pdf["colour"].to_numpy()), **how, counts=pdf["n"].to_numpy())
            return pd.DataFrame({"group": [pdf["group"].iloc[0]], "model": [json.dumps(model)]})

        pool = groupfit.pooled_colours(picked, "group", "pixels")
        models = {r["group"]: json.loads(r["model"]) for r in pool.groupBy("group").applyInPandas(one, "group string, model string").collect()}
        shared = self.spark.sparkContext.broadcast(models)

        def score(frames):
            for pdf in frames:
                out = []
                for row in pdf.itertuples(index=False):
                    own = row.group if row.group in shared.value else groupfit.POPULATION
                    model, px = shared.value[own], np.frombuffer(row.pixels, np.uint8).reshape(-1, 3)
                    if kind == "color_clusters":
                        value = groupfit.palette_shares(px, model)
                    else:
                        value = raster.threshold_fractions(raster.Segment(px[None], np.ones((1, len(px)), bool)), model["thresholds"])
                        hues = {k: v for k, v in value.items() if k.startswith("hue_")}
                        value["dominant"] = int(max(hues, key=hues.get).split("_")[1]) if any(hues.values()) else None
                    out.append((row.occurrence_id, canonical_json(value | {"group": None if own == groupfit.POPULATION else own})))
                yield pd.DataFrame(out, columns=[ID, "value_json"])

        measured = pixels if kind == "color_clusters" else self.pooled_pixels(part, group_col, None)
        scored = tables.written(measured.mapInPandas(score, f"{ID} string, value_json string"))
        recipe = Recipe("metric", run_name, [Operation(kind, _stored, "metric", {"models": models}, metric_name=kind, unit="fraction")], part)
        self._pin(recipe, True)
        run_id = self._start(recipe, None)
        rows = scored.select(ID, F.lit(part).alias("part"), F.lit(kind).alias("metric_name"), "value_json", F.lit("fraction").alias("unit"), F.lit(None).cast("string").alias("source_mask_hash"))
        self.append_metrics(rows, run_id, recipe.hash)
        self._finish(run_id, recipe, None, {"done": rows.count()})
        return scored

    def render_segments(self, folder: str, transforms: Sequence[Operation] = (), part: str = ORGANISM, subset: str | None = None, transparent: bool = True, reference: bool = False) -> int:
        """One PNG cutout per occurrence after a chain of transforms, written by the tasks; the folder's name holds the recipe's hash."""
        recipe = Recipe("render", os.path.basename(folder), list(transforms), part, None, {"masks": "reference" if reference else "canonical", "transparent": transparent})
        target = f"{folder}_{recipe.hash}"
        work = self.select_ids(subset).join(self.images().select(ID, "height", "width", "data"), ID).join(self._sources(part, reference), ID)

        def write(frames):
            import pandas as pd

            os.makedirs(target, exist_ok=True)
            for pdf in frames:
                done = 0
                for row in pdf.itertuples(index=False):
                    path = f"{target}/{row.occurrence_id}.png"
                    if not os.path.exists(path):
                        s = framed(row)
                        for o in recipe.operations:
                            s, _ = o(s)
                        with open(f"{path}.tmp", "wb") as f:
                            f.write(raster.png_bytes(raster.cutout(s, transparent=transparent)))
                        os.replace(f"{path}.tmp", path)
                        done += 1
                yield pd.DataFrame({"n": [done]})

        return work.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0

    def ingest_detections(self, source: str | DataFrame, url_col: str = "image_url", drop: Mapping | None = None, **options: Any) -> DataFrame:
        """Detections cut from trap sheets, with the sheet and session they come from; determinations that are no organism are left out."""
        return self.ingest_occurrences(source, drop={"determination_name": ["Not Lepidoptera"]} if drop is None else drop, transform=[files.sheet_columns, *options.pop("transform", [])], image_url_col=url_col, **options)

    # Registry, summary, archive ---------------------------------------------------------------------------

    def register_model(self, name: str, path: str | None = None, fingerprint: bool = True, **facts: Any) -> dict:
        """A named model with the digest of its checkpoint; its identity enters recipe hashes."""
        digest = files.content_hash(Path(path).read_bytes()) if path and fingerprint and os.path.isfile(path) else None
        record = {"name": name, "path": path, "sha256": digest, "at": _now(), **facts}
        tables.write_json(self.log("models.json"), self.list_models() | {name: record})
        return record

    def list_models(self) -> dict[str, dict]:
        return tables.read_json(self.log("models.json"), {})

    def load_model(self, name: str) -> dict:
        record = self.list_models()[name]
        if record["sha256"] and files.content_hash(Path(record["path"]).read_bytes()) != record["sha256"]:
            raise ValueError(f"the checkpoint of {name!r} is not the registered one")
        return record

    def unregister_model(self, name: str) -> None:
        tables.write_json(self.log("models.json"), {k: v for k, v in self.list_models().items() if k != name})

    def summarize(self) -> dict:
        """Counts of occurrences, images, masks by part, values and occurrences by run, part and metric."""
        runs = self._read("runs", RUNS).select("run_id", "name").distinct()
        values = self._read("metrics", METRICS).join(runs, "run_id").groupBy("name", "part", "metric_name").agg(F.count("*").alias("n_values"), F.count_distinct(ID).alias("n_occurrences"))
        return {
            "occurrences": self.occurrences().count() if tables.exists(self.spark, self.at("occurrences")) else 0, "images": self.images().count(),
            "masks": {r["part"]: r["count"] for r in self.load_masks().groupBy("part").count().collect()}, "reference_masks": {r["part"]: r["count"] for r in self.load_masks(reference=True).groupBy("part").count().collect()},
            "metrics": [r.asDict() for r in values.orderBy("name", "part", "metric_name").collect()], "runs": self.load_runs().count(),
        }

    def describe_run(self, run_id: int | None = None, name: str | None = None, kind: str | None = None) -> dict:
        runs = self.load_runs(kind, name)
        row = (runs.where(F.col("run_id") == run_id) if run_id is not None else runs).first()
        if row is None:
            raise KeyError(name or run_id)
        return row.asDict() | {"recipe": json.loads(row["recipe_json"])}

    def archive(self, dest: str) -> list[str]:
        """A copy of tables and logs to deposit: image pixels left out, absolute paths cut to file names."""
        copied = []
        for name in ("occurrences", "masks", "reference_masks", "metrics", "runs", "pointers", "calibrations"):
            if tables.exists(self.spark, self.at(name)):
                df = tables.load_table(self.spark, self.at(name))
                cut = {c: F.regexp_extract(F.col(c), r"[^/\\]+$", 0) for c, t in df.dtypes if t == "string" and c in ("path", "source_path")}
                df.withColumns(cut).write.mode("overwrite").parquet(f"{dest}/{name}")
                copied.append(name)
        for file in ("imports.jsonl", "exports.jsonl", "runs.jsonl", "models.json", "subsets.toml"):
            if tables.exists(self.spark, self.log(file)):
                held = tables.read_log(self.log(file)) if file.endswith(".jsonl") else None
                tables.write_bytes(f"{dest}/{file}", tables.read_bytes(self.log(file)) if held is None else "".join(canonical_json(x) + "\n" for x in held).encode())
                copied.append(file)
        return copied


def _stored(_: Any, **__: Any) -> None:
    raise raster.NothingToMeasure("values of this run were stored, not measured")


def _named(transform: Any) -> list[str]:
    steps = transform if isinstance(transform, list | tuple) else [transform] if transform else []
    return [f"{getattr(s, '__module__', '')}.{getattr(s, '__qualname__', repr(s))}" for s in steps]


def _plain(rules: Any) -> Any:
    """Rules as JSON can hold them; functions by their name."""
    if callable(rules):
        return _named(rules)[0]
    if isinstance(rules, Mapping):
        return {str(k): _plain(v) for k, v in rules.items()}
    if isinstance(rules, set | frozenset):
        return sorted(map(_plain, rules), key=str)
    return [_plain(v) for v in rules] if isinstance(rules, list | tuple) else rules
