"""Committed outputs: staged write, manifest, atomic publish (K3-K5, K7).

An output folder holds parts.  A part is written by Spark into a staging folder,
its files are moved under their final name in one rename, and then its manifest is put in
place by another: name, format, schema, rows, and every file with its rows' bytes and the byte offset
at which it starts in the part, in order.  Readers go by the manifests, so a part that was
interrupted anywhere is never seen, and publishing a name again replaces that part only.

Rows are counted while they are written (``observe``), without another pass.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "_manifests"


class _Store:
    """The few file-system calls that a commit needs, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[tuple[str, int]]:
        if not self.fs.exists(self._p(folder)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._p(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._p(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._p(new).getParent())
        if not self.fs.rename(self._p(old), self._p(new)):
            raise OSError(f"can't rename {old} to {new} in {self.path}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._p(name), True)


def manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """Manifest of every published part, by name."""
    store = _Store(spark, path)
    found = [json.loads(store.read(f"{MANIFESTS}/{n}")) for n, _ in store.names(MANIFESTS) if n.endswith(".json")]
    return {m["name"]: m for m in sorted(found, key=lambda m: m["name"])}


def publish(df: DataFrame, path: str, name: str, fmt: str = "parquet", **options) -> dict:
    """Write ``df`` as part ``name`` of the folder ``path``; returns its manifest."""
    spark, store = df.sparkSession, _Store(df.sparkSession, path)
    before = store.names(MANIFESTS)
    old = json.loads(store.read(f"{MANIFESTS}/{name}.json")) if any(n == f"{name}.json" for n, _ in before) else None
    folder, staging, counted = f"{name}-{uuid.uuid4().hex}", f"_staging-{uuid.uuid4().hex}", Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.format(fmt).options(**options).save(f"{store.path}/{staging}")
    files, at = [], 0
    for n, size in store.names(staging):
        if not n.startswith(("_", ".")):
            files.append({"name": n, "bytes": size, "offset": at})
            at += size
    store.move(staging, folder)
    manifest = {"name": name, "folder": folder, "format": fmt, "schema": df.schema.json(), "rows": counted.get["rows"], "files": files}
    store.write(f"{MANIFESTS}/.{folder}", json.dumps(manifest))
    if old:
        store.delete(f"{MANIFESTS}/{name}.json")
    store.move(f"{MANIFESTS}/.{folder}", f"{MANIFESTS}/{name}.json")
    if old:
        store.delete(old["folder"])
    return manifest


def read_committed(spark: SparkSession, path: str, names: list[str] | None = None, schema: T.StructType | None = None,
                   part: str | None = None) -> DataFrame:
    """Rows of the published parts (of ``names``, or all).  ``part`` names a column for the
    part's name.  Without any part: an empty table of ``schema``."""
    parts = {n: m for n, m in manifests(spark, path).items() if names is None or n in names}
    if not parts:
        if schema is None:
            raise FileNotFoundError(f"nothing is published in {path}")
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(part, F.lit(None).cast("string")) if part else empty
    out = None
    groups: dict = {}
    for m in parts.values():  # parts of one format and schema are one scan
        groups.setdefault((m["format"], m["schema"]), []).append(m)
    for (fmt, schema_json), ms in groups.items():
        wanted = T.StructType.fromJson(json.loads(schema_json))
        df = spark.read.format(fmt).schema(wanted).load([f"{path.rstrip('/')}/{m['folder']}/{f['name']}" for m in ms for f in m["files"]]
                                                        or [f"{path.rstrip('/')}/{m['folder']}" for m in ms])
        if part:
            df = df.withColumn(part, F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)-[0-9a-f]{32}/[^/]+$", 1))
        out = df if out is None else out.unionByName(df)
    return out


def publish_lines(lines: DataFrame, path: str, name: str, order: str = "n", text: str = "line") -> dict:
    """K4/K5 as a text part: the files in the manifest's order, put one behind
    the other, are the whole file, each line with its line end."""
    return publish(lines.orderBy(order).select(text), path, name, "text")


def whole_file_order(manifest: dict) -> list[str]:
    """The part's files in the order of their offsets."""
    return [f["name"] for f in sorted(manifest["files"], key=lambda f: f["offset"])]
