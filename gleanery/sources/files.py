"""Sources of occurrences and images: text CSV, tolerant tab-separated archives, image folders, mask folders, SQLite, paged HTTP lists."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleanery.functions.nulls import to_number, to_timestamp
from gleanery.functions.raster import plain_png, png_bytes, read_png
from gleanery.sources import tables

ID = "occurrence_id"
POSITION = "_pos"
#: Ids that stand for no id.
NO_IDS = ("", "nan", "None", "<NA>", "NaT")


def with_position(df: DataFrame) -> DataFrame:
    """Source order as a column; increasing, not consecutive."""
    return df.withColumn(POSITION, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with a header, every column STRING, only the empty field NULL ("NA" is a value), in source order."""
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "").option("emptyValue", "").option("inferSchema", False).csv(path)
    return with_position(df)


def normalize(df: DataFrame, id_col: str | None = None, image_col: str | None = None, datetime_cols: Sequence[str] = (), numeric_cols: Sequence[str] = ()) -> DataFrame:
    """Id and image columns renamed, dates and numbers parsed (NULL where they can't be), the id as STRING; named columns that are absent are ignored."""
    if id_col and id_col in df.columns and id_col != ID:
        df = df.drop(ID).withColumnRenamed(id_col, ID)
    if image_col and image_col in df.columns and image_col != "image_url":
        df = df.drop("image_url").withColumnRenamed(image_col, "image_url")
    df = df.withColumns({c: to_timestamp(F.col(c)) for c in datetime_cols if c in df.columns} | {c: to_number(F.col(c)) for c in numeric_cols if c in df.columns})
    return df.withColumn(ID, F.col(ID).cast("string")) if ID in df.columns else df


def validate_ids(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` itself, or ValueError naming up to five ids that are missing or repeated."""
    if ID not in df.columns:
        raise KeyError(f"the {what} has no column {ID}")
    absent = df.where(F.col(ID).isNull() | F.col(ID).isin(*NO_IDS)).limit(5).count()
    if absent:
        raise ValueError(f"the {what} has rows without an id")
    repeated = [r[0] for r in df.groupBy(ID).count().where("count > 1").orderBy(ID).limit(5).collect()]
    if repeated:
        raise ValueError(f"the {what} repeats ids, e.g. {repeated}")
    return df


#: Columns of a verbatim record that leak into a media table, by position.
VERBATIM_FIELDS = 15


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, verbatim: Sequence[str] | None = None) -> DataFrame:
    """A tab-separated table without quoting, all STRING, empty is NULL, in source order.

    Rows of another width are left out, except where they have the width of ``verbatim`` (the column order of a record
    that leaked in): those are mapped by name.
    """
    lines = with_position(spark.read.text(path))
    head = lines.orderBy(POSITION).first()
    header = head["value"].rstrip("\r").split("\t")
    cells = F.transform(F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1), lambda x: F.when(x != "", x))
    rows = lines.where(F.col(POSITION) != head[POSITION]).select(cells.alias("c"), POSITION)
    exact = F.size("c") == len(header)
    mapped = F.col("c")
    keep = exact
    if verbatim:
        places = [list(verbatim).index(h) if h in verbatim else -1 for h in header]
        leaked = F.size("c") == len(verbatim)
        mapped = F.when(exact, F.col("c")).otherwise(F.array(*[F.get("c", k) if k >= 0 else F.lit(None).cast("string") for k in places]))
        keep = exact | leaked
    wanted = columns or header
    return rows.where(keep).select(*[F.get(mapped, header.index(h)).alias(h) for h in wanted if h in header], POSITION)


def locate_archive(path: str, folder: str) -> dict[str, str]:
    """Paths of occurrence.txt and multimedia.txt of a zip or directory: found whatever their case, at the shallowest depth; a tie is an error."""
    if os.path.isfile(path) and zipfile.is_zipfile(path):
        target = tempfile.mkdtemp(dir=folder)
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                if name.lower().endswith((".txt", ".xml")) and ".." not in Path(name).parts and not Path(name).is_absolute():
                    z.extract(name, target)
        path = target
    found = {}
    for wanted in ("occurrence.txt", "multimedia.txt"):
        hits = sorted((p for p in Path(path).rglob("*") if p.name.lower() == wanted), key=lambda p: (len(p.parts), str(p)))
        if hits:
            if len(hits) > 1 and len(hits[0].parts) == len(hits[1].parts):
                raise ValueError(f"several {wanted} at one depth: {hits[:2]}")
            found[wanted.removesuffix(".txt")] = str(hits[0])
    if "occurrence" not in found:
        raise FileNotFoundError(f"no occurrence.txt in {path}")
    return found


def select_media(media: DataFrame, rule: str = "first", media_type: str | None = "StillImage", key: str = "gbifID") -> DataFrame:
    """One media row per record, the first or last of the wanted type in file order."""
    if rule not in ("first", "last"):
        raise ValueError("rule is 'first' or 'last'")
    kept = media if media_type is None else media.where(F.col("type") == media_type)
    pick = (F.min_by if rule == "first" else F.max_by)(F.struct(*[c for c in media.columns if c != key]), POSITION)
    return kept.groupBy(key).agg(pick.alias("_m")).select(key, "_m.*")


def merge_media(records: DataFrame, media: DataFrame, key: str = "gbifID") -> DataFrame:
    """Records with their media columns (prefix media_); those without an image address go."""
    prefixed = media.select(F.col(key), *[F.col(c).alias(f"media_{c}") for c in media.columns if c not in (key, POSITION)])
    return records.join(prefixed, key, "left").where("media_identifier is not null")


#: Hosts whose photo addresses name the size.
PHOTO_HOSTS = ("inaturalist-open-data.s3.amazonaws.com", "static.inaturalist.org")


def photo_size(url: Column, size: str) -> Column:
    """Address of the same photo in another size, for hosts that name the size; others stay."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.when(host.isin(*PHOTO_HOSTS), F.regexp_replace(url, r"/[^/?]+?(\.[^./?]*)?(\?|$)", F.lit(f"/{size}$1$2"))).otherwise(url)


def sheet_columns(df: DataFrame, url_col: str = "image_url") -> DataFrame:
    """``df`` with sheet_image_id (device/date/sheet file) and session_path (device/date), from the address of a detection cut from a sheet; NULL where it isn't one."""
    path = F.try_parse_url(url_col, F.lit("PATH"))
    folder, stem, extension = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.regexp_extract(path, r"([^/]+?)_detection_[^/_]*(?:_[^/]*?)?(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    device = F.substring_index(stem, "_", 1)
    known = (folder != "") & (stem != "")
    return df.withColumn("sheet_image_id", F.when(known, F.concat_ws("/", device, folder, F.concat(stem, extension)))).withColumn("session_path", F.when(known, F.concat_ws("/", device, folder)))


def images(spark: SparkSession, folder: str, patterns: str = "*.{png,jpg,jpeg,PNG,JPG,JPEG}", recursive: bool = False) -> DataFrame:
    """(occurrence_id, path, height, width, data BGR, bytes, modified): ids are file stems; files that are no image are left out.

    On a mounted path a task lists the folder and tasks read its plain PNGs, so the driver holds no file names. Files of
    other kinds, and folders of other file systems, are Spark's to list and decode.
    """
    local = folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") or "://" not in folder else None
    if local is None or not os.path.isdir(local):
        return _images_by_spark(spark, folder, patterns, recursive)
    local = os.path.abspath(local)
    parts = re.fullmatch(r"(.*?)\{(.*)\}(.*)", patterns)
    globs = [f"{parts[1]}{x}{parts[3]}" for x in parts[2].split(",")] if parts else [patterns]

    def listed(_):
        import fnmatch

        import pandas as pd

        def walk(place):
            with os.scandir(place) as entries:
                for e in entries:
                    if e.name.startswith(("_", ".")):
                        continue
                    if e.is_dir():
                        if recursive:
                            yield from walk(e.path)
                    elif any(fnmatch.fnmatchcase(e.name, g) for g in globs):
                        yield e.path

        some: list[str] = []
        for path in walk(local):
            some.append(path)
            if len(some) == 10_000:
                yield pd.DataFrame({"path": some})
                some = []
        if some:
            yield pd.DataFrame({"path": some})

    def looked(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for path in pdf["path"]:
                held = os.stat(path)
                with open(path, "rb") as f:
                    out.append((path, held.st_size, held.st_mtime_ns // 1_000_000, plain_png(f)))
            yield pd.DataFrame(out, columns=["path", "bytes", "modified", "plain"])

    def decoded(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    image = read_png(Path(r.path).read_bytes())
                except Exception:  # damaged: no image
                    continue
                out.append((f"file:{r.path}", r.bytes, r.modified, *image.shape[:2], 1 if image.ndim == 2 else image.shape[2], image.tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["path", "bytes", "modified", "height", "width", "channels", "data"]).astype({"height": "int32", "width": "int32", "channels": "int32"})

    names = tables.written(spark.range(0, 1, 1, 1).mapInPandas(listed, "path string"))
    found = tables.written(tables.spread(names, "path").mapInPandas(looked, "path string, bytes long, modified long, plain boolean"))
    pixels = tables.spread(found.where("plain").drop("plain"), "path").mapInPandas(decoded, "path string, bytes long, modified long, height int, width int, channels int, data binary")
    out = pixels.select(F.regexp_extract("path", _STEM, 1).alias(ID), "path", "bytes", F.timestamp_millis("modified").alias("modified"), "height", "width", "channels", "data")
    rest = found.where("not plain").select(F.concat(F.lit("file:"), "path").alias("path"))
    if rest.isEmpty():
        return out
    return out.unionByName(_images_by_spark(spark, folder, patterns, recursive).join(tables.shuffled(rest), "path", "left_semi"))


_STEM = r"([^/]+?)(\.[^./]*)?$"


def _images_by_spark(spark: SparkSession, folder: str, patterns: str, recursive: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    stem = F.regexp_extract("path", _STEM, 1)
    decoded = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", patterns).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    pixels = decoded.select(F.col("image.origin").alias("_origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    held = files.select(stem.alias(ID), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    tail = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    return held.join(pixels, tail(F.col("path")) == tail(F.col("_origin"))).drop("_origin")


def unique_stems(df: DataFrame) -> DataFrame:
    """``df`` itself, or ValueError where two files would share an id."""
    twice = [r[0] for r in df.groupBy(ID).count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"several files have the name {twice}")
    return df


def mask_files(files: DataFrame, known: DataFrame, part: str = "organism") -> DataFrame:
    """Mask images with their occurrence and part: ``id__part`` is cut at the last ``__``, unless the whole stem is a known id."""
    stem = F.col(ID)
    marked = files.join(tables.shuffled(known.select(F.col(ID).alias("_whole")).distinct()), stem == F.col("_whole"), "left")
    cut = stem.contains("__") & F.col("_whole").isNull()
    return marked.withColumn("part", F.when(cut, F.regexp_extract(stem, r"__((?:(?!__).)*)$", 1)).otherwise(part)).withColumn(ID, F.when(cut, F.regexp_extract(stem, r"^(.*)__", 1)).otherwise(stem)).drop("_whole")


_UNSAFE = re.compile(r'[<>:"/\\|?*\x00-\x1f]')


def check_names(names: Sequence[str]) -> None:
    """ValueError for names that no file system takes, or that differ in case only."""
    bad = [n for n in names if _UNSAFE.search(n) or not n.strip(". ")]
    if bad:
        raise ValueError(f"not a file name: {bad[:5]}")
    folded = {}
    for n in names:
        if folded.setdefault(n.lower(), n) != n:
            raise ValueError(f"{n} and {folded[n.lower()]} differ in case only")


def write_images(df: DataFrame, name_col: str, height: str, width: str, data: str, folder: str) -> int:
    """One PNG per row into a shared folder; channels follow from the data's length. The tasks write, nothing comes to the driver but a count."""

    def write(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                h, w = int(getattr(row, height)), int(getattr(row, width))
                pixels = np.frombuffer(getattr(row, data), np.uint8)
                image = pixels.reshape(h, w) if len(pixels) == h * w else pixels.reshape(h, w, -1)
                target = Path(folder) / f"{getattr(row, name_col)}.png"
                target.parent.mkdir(parents=True, exist_ok=True)
                partial = target.with_suffix(f".{os.getpid()}.tmp")
                partial.write_bytes(png_bytes(image))
                os.replace(partial, target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select(name_col, height, width, data).mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str, key: str | None = None, partitions: int = 1) -> DataFrame:
    """Rows of a SQLite file on shared storage; with an integer ``key`` read in ranges by several tasks."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT min({key}), max({key}) FROM ({query})").fetchone() if key else (None, None)
    ranges = [(None, None)]
    if low is not None and partitions > 1:
        step = max(1, -(-(high - low + 1) // partitions))
        ranges = [(a, a + step) for a in range(low, high + 1, step)]

    def read(frames):
        import pandas as pd

        for pdf in frames:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    where = "" if a is None or a != a else f" WHERE {key} >= {int(a)} AND {key} < {int(b)}"
                    for part in pd.read_sql_query(f"SELECT * FROM ({query}){where}", db, chunksize=10_000):
                        yield part

    parts = spark.createDataFrame([(a, b) for a, b in ranges], "a long, b long").repartition(len(ranges))
    return parts.mapInPandas(read, schema)


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def archive_raw(source: str, folder: str, prefix: str) -> str:
    """A copy of an imported file named by its content; the same content is kept once."""
    digest = content_hash(Path(source).read_bytes())
    target = Path(folder) / f"{prefix}_{digest[:16]}{Path(source).suffix}"
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        partial = target.with_name(f"{target.name}.tmp")
        shutil.copyfile(source, partial)
        os.replace(partial, target)
    return digest


class PagedSource(DataSource):
    """``format("paged_json")``: a list endpoint whose pages are chained by a ``next`` address.

    Options url, page_size, items (name of the list, default results), token. One partition: a page's address is known
    only from the page before. Rows are (position, record JSON text).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "position long, record string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        position = 0
        for record in pages(self.options["url"], int(self.options.get("page_size", 100)), self.options.get("items", "results"), self.options.get("token")):
            yield position, json.dumps(record)
            position += 1


def pages(url: str, page_size: int = 100, items: str = "results", token: str | None = None, fetch: Callable[[str], Any] | None = None) -> Iterator[Any]:
    """Records of a paged list, following ``next``; an address seen before ends it."""
    import urllib.request

    def get(address: str) -> Any:
        request = urllib.request.Request(address, headers={"Authorization": f"Token {token}"} if token else {})
        with urllib.request.urlopen(request, timeout=60) as reply:
            return json.load(reply)

    seen, at = set(), f"{url}{'&' if '?' in url else '?'}limit={page_size}"
    while at and at not in seen:
        seen.add(at)
        page = (fetch or get)(at)
        yield from page.get(items, [])
        at = page.get("next")


def download(pending: DataFrame, url_col: str, timeout: float = 30, threads: int = 8, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """(occurrence_id, content, error) for every pending row, fetched by threads inside each task; a failed address has an error and no content."""

    def run(frames):
        import urllib.request
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        def get(url):
            try:
                if fetch:
                    return fetch(url), None
                with urllib.request.urlopen(url, timeout=timeout) as reply:
                    return reply.read(), None
            except Exception as e:  # any failure of one address is that row's result
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                got = list(pool.map(get, pdf[url_col]))
                yield pd.DataFrame({ID: pdf[ID], "content": [g[0] for g in got], "error": [g[1] for g in got]})

    return pending.select(ID, url_col).mapInPandas(run, f"{ID} string, content binary, error string")


def pending_downloads(occurrences: DataFrame, stored: DataFrame, failures: DataFrame | None, url_col: str = "image_url", limit: int | None = None, max_new: int | None = None, retry_failed: bool = False) -> DataFrame:
    """Occurrences with an address, without an image, that didn't fail before with the same address; ``limit`` counts all, ``max_new`` the pending ones."""
    have = occurrences.where(F.col(url_col).isNotNull() & (F.col(url_col) != ""))
    have = have if limit is None else have.orderBy(ID).limit(limit)
    out = have.join(stored.select(ID), ID, "left_anti")
    if failures is not None and not retry_failed:
        failed = failures.where("stage = 'download'").select(F.col(ID).alias("_id"), "context_hash")
        out = out.join(failed, (out[ID] == failed["_id"]) & (F.substring(F.sha2(out[url_col], 256), 1, 16) == failed["context_hash"]), "left_anti")
    return out if max_new is None else out.orderBy(ID).limit(max_new)
