"""REST and gRPC sources, and snapshot directories with a manifest."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon import types as kinds
from quillon.config import SourceConfig, TableConfig
from quillon.errors import Code, make
from quillon.sources.base import SourceProvider, Table
from quillon.sources.datasource import register, rest_pages


class RestProvider(SourceProvider):
    """``{base_url, method, headers, auth?, pagination?, pushdown?, tables?}``; a table may have a path of its own."""

    type_name = "rest"

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        register(spark)
        o = dict(config.options)
        o.setdefault("base_url", config.url)
        if not o["base_url"]:
            raise make(Code.MISSING_FIELD, f"source '{config.name}' needs base_url")

        def scan(t: TableConfig) -> DataFrame:
            own = {**o, "path": t.path or o.get("path")}
            schema = kinds.declared(t.columns)
            if schema is None:
                first = next(rest_pages({**own, "max_pages": 1}), [])
                if not first:
                    raise make(Code.CONFIG_ERROR, f"source '{config.name}': nothing to infer '{t.name}' from")
                schema = kinds.infer_json(first[0])
            return spark.read.format("quillon_rest").schema(schema).option("config", json.dumps(own)).load()

        return [Table(t.schema, t.name, lambda t=t: scan(t)) for t in config.tables or [TableConfig(config.name)]]


class GrpcProvider(SourceProvider):
    """A unary gRPC method. The call needs the ``grpc`` module, which is loaded where it is used."""

    type_name = "grpc"

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        o = config.options
        for key in ("service", "method"):
            if not o.get(key):
                raise make(Code.MISSING_FIELD, f"source '{config.name}' needs {key}")
        columns = config.tables[0].columns if config.tables else [kinds.ColumnConfig(**c) for c in o.get("columns", [])]
        schema = kinds.declared(columns, kinds.from_grpc)

        def scan() -> DataFrame:
            records = self.call(config)
            return spark.createDataFrame(records, schema or kinds.infer_json(records[0]))

        return [Table("public", config.tables[0].name if config.tables else config.name, scan)]

    def call(self, config: SourceConfig) -> list[dict]:
        try:
            import grpc
            from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory
        except ImportError as e:
            raise make(Code.NOT_IMPLEMENTED, "gRPC sources need the grpc module") from e
        o, pool = config.options, descriptor_pool.DescriptorPool()
        with open(o["descriptor_set"], "rb") as f:
            for file in descriptor_pb2.FileDescriptorSet.FromString(f.read()).file:
                pool.Add(file)
        method = pool.FindServiceByName(o["service"]).FindMethodByName(o["method"])
        ask, answer = (message_factory.GetMessageClass(m) for m in (method.input_type, method.output_type))
        with grpc.insecure_channel(config.url.split("://")[-1]) as channel:
            run = channel.unary_unary(f"/{o['service']}/{o['method']}", request_serializer=lambda m: m.SerializeToString(), response_deserializer=answer.FromString)
            reply = json_format.MessageToDict(run(json_format.ParseDict(o.get("request_body") or {}, ask())), preserving_proto_field_name=True)
        lists = [v for v in reply.values() if isinstance(v, list)]
        return lists[0] if len(lists) == 1 else [reply]


def snapshot_path(manifest: dict[str, Any], snapshot_id: int | None = None, timestamp_ms: int | None = None, tag: str | None = None) -> str:
    """The directory of a snapshot: by id, the latest at or before a time, by tag; else the current one."""
    snaps = sorted(manifest["snapshots"], key=lambda s: s["timestamp_ms"])
    if tag is not None:
        snapshot_id = manifest.get("tags", {}).get(tag)
        if snapshot_id is None:
            raise make(Code.CONFIG_ERROR, f"no tag '{tag}'", tags=sorted(manifest.get("tags", {})))
    found = [s for s in snaps if (snapshot_id is None or s["id"] == snapshot_id) and (timestamp_ms is None or s["timestamp_ms"] <= timestamp_ms)]
    if not found:
        raise make(Code.CONFIG_ERROR, "no such snapshot", snapshot_id=snapshot_id, timestamp_ms=timestamp_ms)
    return found[-1]["path"]


class SnapshotProvider(SourceProvider):
    """Parquet directories listed by a JSON manifest: time travel without a table format."""

    type_name = "snapshots"

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        o = config.options
        manifest = json.loads("\n".join(r[0] for r in spark.read.text(o["manifest"], wholetext=True).collect()))
        path = snapshot_path(manifest, **{k: o["version"][k] for k in ("snapshot_id", "timestamp_ms", "tag") if k in (o.get("version") or {})})
        return [Table("public", t.name, lambda: spark.read.parquet(path), kinds.declared(t.columns)) for t in config.tables or [TableConfig(config.name)]]
