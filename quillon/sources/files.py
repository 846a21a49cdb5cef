"""Parquet, CSV and JSON on any file system that Spark reads, with globs and declared schemas."""

from __future__ import annotations

import glob
import os
import tempfile
import urllib.request

from pyspark.sql import DataFrame, SparkSession

from quillon.config import SourceConfig, TableConfig
from quillon.errors import Code, make
from quillon.sources.base import SourceProvider, Table
from quillon.types import declared

FORMATS = ("parquet", "csv", "json")


def format_of(config: SourceConfig, path: str) -> str:
    kind = config.options.get("format") or (config.type if config.type in FORMATS else path.rstrip("/").rsplit(".", 1)[-1].lower())
    kind = {"ndjson": "json", "tsv": "csv", "pq": "parquet"}.get(kind, kind)
    if kind not in FORMATS:
        raise make(Code.CONFIG_ERROR, f"unknown file format of {path!r}", formats=FORMATS)
    return kind


def fetched(path: str, spark: SparkSession | None = None) -> str:
    """http(s) and ftp files are fetched once by the driver; every other scheme is Spark's own business.

    Where the session names a shared folder (spark.checkpoint.dir) the file is moved there, so that
    executors can read it.
    """
    if not path.startswith(("http://", "https://", "ftp://")):
        return path
    local = os.path.join(tempfile.mkdtemp(prefix="quillon-fetch-"), os.path.basename(path.split("?")[0]) or "file")
    with urllib.request.urlopen(path, timeout=60) as r, open(local, "wb") as f:
        while chunk := r.read(1 << 20):
            f.write(chunk)
    shared = spark.conf.get("spark.checkpoint.dir", None) if spark is not None else None
    if not shared:
        return local
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    to = jpath(f"{shared.rstrip('/')}/quillon-fetch-{os.urandom(6).hex()}/{os.path.basename(local)}")
    to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, jpath(local), to)
    return to.toString()


def object_store_options(config: SourceConfig) -> dict[str, str]:
    """Hadoop settings for s3a, abfss and gs from a source's options; these go to spark.conf as spark.hadoop.*."""
    o, out = config.options.get("options", config.options) or {}, {}
    names = {"access_key_id": "fs.s3a.access.key", "secret_access_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "endpoint": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region", "google_service_account": "fs.gs.auth.service.account.json.keyfile"}
    for key, value in o.items():
        if key in names:
            out[names[key]] = str(value)
        elif key == "account_key" and "account_name" in o:
            out[f"fs.azure.account.key.{o['account_name']}.dfs.core.windows.net"] = str(value)
    return out


def spark_path(path: str) -> str:
    """Scheme names as Hadoop knows them."""
    for old, new in (("s3://", "s3a://"), ("az://", "abfss://"), ("azblob://", "abfss://"), ("gcs://", "gs://")):
        if path.startswith(old):
            return new + path[len(old) :]
    return path


def read_file(spark: SparkSession, config: SourceConfig, path: str, table: TableConfig | None = None) -> DataFrame:
    kind, o = format_of(config, path), config.options
    reader = spark.read
    schema = declared(table.columns) if table else None
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        header = bool(o.get("has_header", False))
        reader = reader.option("header", header).option("sep", o.get("delimiter", ",")).option("enforceSchema", not header or schema is None)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return getattr(reader, kind)(spark_path(fetched(path, spark)))


def footer_rows(path: str) -> int | None:
    """Rows by the parquet footers, for files that the driver can open; None if it cannot tell."""
    import pyarrow.parquet as pq

    path = path.removeprefix("file://")
    files = glob.glob(f"{path}/**/*.parquet", recursive=True) if os.path.isdir(path) else glob.glob(path)
    try:
        return sum(pq.read_metadata(f).num_rows for f in files) if files else None
    except Exception:
        return None


class FileProvider(SourceProvider):
    """``{path, format?, has_header?, delimiter?, tables?}``; without tables, one named like the source."""

    type_name, aliases = "file", FORMATS

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        path = config.options.get("path") or config.url
        if not path and not any(t.path for t in config.tables):
            raise make(Code.MISSING_FIELD, f"source '{config.name}' needs a path")
        out = []
        for t in config.tables or [TableConfig(config.name)]:
            at = t.path or path
            parquet = format_of(config, at) == "parquet"
            # A declared schema of a parquet file is what readers see; what the file holds is repaired to it.
            out.append(Table(t.schema, t.name, lambda at=at, t=t, p=parquet: read_file(spark, config, at, None if p else t), declared(t.columns), rows=lambda at=at, p=parquet: footer_rows(at) if p else None))
        return out
