"""Transcriptions, templates, dictionaries, images and manifests from files."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key, normalize, stem
from ..operators.parse import Field

#: Suffixes of images.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif")


class NoInput(ValueError):
    """Nothing to read where something must be."""


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths and sizes of files by pattern, those of zero bytes too, which Spark's readers leave out. A listing is on the driver, as any scan's is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = sorted((x.getPath().toString(), x.getLen()) for x in found if x.isFile())
    return spark.createDataFrame(rows, "path string, bytes long")


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, as Hadoop writes it, and its path there."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", folder)
    return fs.FileSystem.from_uri(quote(folder, safe=":/@"))


def _names(folder: str) -> Iterator[str]:
    at, path = store(folder)
    if isinstance(at, fs.LocalFileSystem):
        with os.scandir(path) as found:
            yield from (x.name for x in found if x.is_file())
    else:
        yield from (x.base_name for x in at.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File)


def _listed(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Paths of files by pattern, found by executors: the driver has the folders only. None if it takes Hadoop."""
    above, _, name = pattern.rpartition("/")
    if not above or re.search(r"[{}\\\[\]]", name):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(above)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = sorted(x.getPath().toString() for x in found if x.isDirectory())
    try:
        for x in folders:
            store(x)
    except (pa.ArrowException, OSError):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch[0].to_pylist():
                names = (x for x in _names(folder) if fnmatch.fnmatchcase(x, name))
                while few := list(islice(names, 10_000)):
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{x}" for x in few]})

    return spark.createDataFrame([(x,) for x in folders], "path string").repartition(max(1, len(folders)), "path").mapInArrow(run, "path string")


#: Bytes of files that a worker hands on at once.
READ = 4_000_000


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in batches:
        rows, size = [], 0
        for path in batch[0].to_pylist():
            at, own = store(path)
            with at.open_input_stream(own) as file:
                rows.append({"path": path, "content": file.read()})
            size += len(rows[-1]["content"])
            if size >= READ:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def texts(spark: SparkSession, pattern: str) -> DataFrame:
    """path, text of each file; strict UTF-8, lines end with line feeds, zero bytes are the empty text. Executors list and read; only what they can't open is listed on the driver."""
    found = _listed(spark, pattern)
    if found is None:
        files = listing(spark, pattern)
    else:
        files = found.repartition(4 * spark.sparkContext.defaultParallelism, "path")  # paths are small, the files aren't
    if (files if found is None else found).isEmpty():
        raise NoInput(pattern)
    if found is None:
        try:
            content = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("_path"), "content")
        except AnalysisException:
            content = spark.createDataFrame([], "_path string, content binary")
        same = lambda c: F.regexp_replace(c, "^file:/+", "/")
        joined = files.join(content, same(F.col("path")) == same(F.col("_path")), "left")
    else:
        joined = files.mapInArrow(_contents, "path string, content binary")
    text = F.coalesce(F.decode("content", "UTF-8"), F.lit(""))
    checked = F.when(F.col("content").isNull() | F.is_valid_utf8(F.col("content").cast("string")), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
    return joined.select("path", F.regexp_replace(checked, "\r\n?", "\n").alias("text"))


def references(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    return texts(spark, f"{folder}/{pattern}").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("text").alias("ref"))


def hypotheses(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """Texts under root/experiment_N/model/."""
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return texts(spark, f"{root}/experiment_*/*/{pattern}").select(part(-3).alias("experiment"), part(-2).alias("model"), part(-1).alias("file"), F.col("text").alias("hyp"))


def models(spark: SparkSession, root: str) -> DataFrame:
    """Folders of models, those without files too."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/experiment_*/*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = sorted((x.getPath().getParent().getName(), x.getPath().getName()) for x in found if x.isDirectory())
    if not rows:
        raise NoInput(root)
    return spark.createDataFrame(rows, "experiment string, model string")


def experiments(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders under a run's output; none yet is no error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.createDataFrame(sorted((x.getPath().getName(),) for x in found if x.isDirectory()), "folder string")


def images(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Images in natural order of their names."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    found = listing(spark, f"{folder}/*").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    if found.isEmpty():
        raise NoInput(folder)
    ordered = found.withColumn("image", F.regexp_extract("path", "([^/]+)$", 1)).orderBy(natural_key(F.col("image")))
    return ordered if limit is None else ordered.limit(limit)


def image_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Base64 in one line of each image."""
    spark.conf.set("spark.sql.chunkBase64String.enabled", "false")
    return spark.read.format("binaryFile").load(folder).select(stem(F.col("path")).alias("image"), F.base64("content").alias("payload"))


def template(data: dict) -> tuple[str, list[str], list[Field]]:
    """Id, documents and fields of a template as loaded from YAML."""
    t = data["template"]
    fields = [Field(f["order"], f["key"]["id"], f["key"]["text"], f["key"]["detection"]["scope"], f["key"]["detection"].get("match", "fuzzy"), f["value"]["id"], f["value"]["category"], f["value"].get("dictionary"), f["value"].get("format_hint")) for f in t["fields"]]
    return t["id"], list(t.get("documents", [])), sorted(fields, key=lambda f: f.order)


def template_fields(spark: SparkSession, found: list[tuple[str, list[str], list[Field]]]) -> DataFrame:
    """A row for each field of each template, with how many documents the template has."""
    rows = [(name, len(documents), f.order, f.key_id, f.key_text, f.scope, f.match, f.field_id, f.category, f.dictionary) for name, documents, fields in found for f in fields]
    return spark.createDataFrame(rows, "template string, documents long, order int, key_id string, key_text string, scope string, match string, field_id string, category string, dictionary string")


def _yaml(spark: SparkSession, pattern: str) -> list[tuple[str, dict]]:
    import yaml

    rows = texts(spark, pattern).orderBy("path").collect()  # a few configuration files
    return [(r["path"], yaml.safe_load(r["text"])) for r in rows]


def terms_of(dictionaries: DataFrame) -> dict[str, list[str]]:
    """Dictionaries as functions take them: configuration, a row for each term."""
    out: dict[str, list[str]] = {}
    for r in dictionaries.collect():
        out.setdefault(r["dictionary"], []).append(r["term"])
    return out


def templates(spark: SparkSession, folder: str) -> list[tuple[str, list[str], list[Field]]]:
    return [template(data) for _, data in _yaml(spark, f"{folder}/template*.yaml")]


def dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """dictionary, term (normalised); no file, no terms."""
    try:
        data = _yaml(spark, path)[0][1]
    except NoInput:
        return spark.createDataFrame([], "dictionary string, term string")
    data = data.get("dictionaries", data)
    rows = [(name, t) for name, terms in data.items() if isinstance(terms, list) for t in map(normalize, map(str, terms)) if t]
    return spark.createDataFrame(rows, "dictionary string, term string")


#: Documents named by templates that are broadcast; more are joined by a shuffle.
ASSIGNED = 1_000_000


def assign(documents: DataFrame, found: list[tuple[str, list[str], list[Field]]]) -> DataFrame:
    """documents (document, ...) with the first template that lists them; none is an error of that row."""
    rows = [(d, i, name) for i, (name, documents_of, _) in enumerate(found) for d in documents_of]
    table = documents.sparkSession.createDataFrame(rows, "document string, place int, template string").groupBy("document").agg(F.min_by("template", "place").alias("template"))
    joined = documents.join(F.broadcast(table) if len(rows) <= ASSIGNED else table, "document", "left")
    return joined.withColumn("template", F.coalesce("template", F.raise_error(F.concat(F.lit("no template for "), "document")).cast("string")))
