"""Vector backends by name: Parquet partitions that the engine searches itself, or a service written to by tasks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import search
from .tables import SCHEMAS, Tables

EPOCH = "1970-01-01T00:00:00+00:00"


def decode_timestamp(value: Column) -> Column:
    """A stored time: as it is, from ISO text, else the start of 1970 (UTC)."""
    return F.coalesce(F.try_to_timestamp(value.cast("string")), F.timestamp_seconds(F.lit(0)))


def decode_metadata(blob: Column) -> Column:
    """A struct of the metadata fields from their JSON text; missing or broken ones get defaults."""
    fields = [x.strip().split(" ", 1) for x in "title string, url string, section_heading string, page_type string, breadcrumb array<string>, code_languages array<string>, chunk_index int, total_chunks int, has_code boolean, content_hash string, crawl_timestamp string".split(", ")]
    parsed = F.from_json(blob, ", ".join(f"{n} {t}" for n, t in fields))
    default = {"string": F.lit(""), "array<string>": F.array().cast("array<string>"), "int": F.lit(0), "boolean": F.lit(False)}
    own = lambda n, t: decode_timestamp(parsed[n]) if n == "crawl_timestamp" else F.coalesce(parsed[n], F.lit("unknown") if n == "page_type" else default[t])
    return F.struct(*[own(n, t).alias(n) for n, t in fields])


class ParquetBackend:
    """The table `vectors`: one folder for each software, version and model."""

    def __init__(self, tables: Tables, options: Mapping[str, Any] | None = None):
        self.tables = tables

    def _mine(self, software: str, version: str | None, model: str | None) -> Column:
        out = F.col("software") == software
        if version is not None:
            out &= F.col("version") == version
        return out if model is None else out & (F.col("model_hash") == ids.model_key(F.lit(model)))

    def write(self, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Drops gone (software, version, chunk_id) of every model, then upserts rows; only in the partitions concerned."""
        if rows is not None or gone is not None:
            self.tables.merge("vectors", rows, gone)

    def read(self, software: str, version: str | None = None, model: str | None = None) -> DataFrame:
        return self.tables.read("vectors").filter(self._mine(software, version, model))

    def search(self, vector: Sequence[float], software: str, version: str, model: str, k: int, filters: Mapping | None, metric: str) -> DataFrame:
        return search.top_k(self.read(software, version, model), vector, k, filters, metric).drop("vector")

    def count(self, software: str, version: str | None = None, model: str | None = None) -> int:
        return self.read(software, version, model).count()

    def delete(self, software: str, version: str | None = None) -> None:
        self.tables.delete("vectors", self._mine(software, version, None))


class ServiceBackend(ParquetBackend):
    """A copy in a remote service: the table stays the record that updates and read-backs go by, every write is passed
    on by tasks in batches, and searches ask the service.

    connect() is called once in each task and gives an object with upsert(collection, list of points), delete(collection,
    list of ids) and search(collection, vector, k, filter). A point has id, vector and payload as the service wants
    them. Writes are repeatable: a task that is run again sends the same points under the same ids.
    """

    def __init__(self, tables: Tables, options: Mapping[str, Any] | None = None):
        super().__init__(tables)
        self.connect = (options or {}).get("connect") or self.client(options or {})
        self.batch = int((options or {}).get("batch", 256))

    @classmethod
    def client(cls, options: Mapping[str, Any]) -> Callable[[], Any]:
        raise ValueError(f"{cls.__name__} needs storage.connect, a function that connects to the service")

    @staticmethod
    def point(row: dict) -> dict:
        payload = {k: v for k, v in row.items() if k not in ("vector",)}
        return {"id": row["chunk_id"], "vector": [float(x) for x in row["vector"]], "payload": payload}

    @staticmethod
    def condition(filters: Mapping[str, Any] | None) -> Any:
        return dict(filters or {}) or None

    @staticmethod
    def _collection(row: Mapping) -> str:
        return f"{row['software']}_{row['version']}_{row['model_hash']}"

    def write(self, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        rows = None if rows is None else self.tables.stage(rows)
        connect, size, point, name = self.connect, self.batch, self.point, self._collection

        def in_batches(part: Iterator[Row], act: Callable[[Any, str, list], None]) -> None:
            service, waiting = connect(), {}
            for r in part:
                row = r.asDict()
                some = waiting.setdefault(name(row), [])
                some.append(row)
                if len(some) >= size:
                    act(service, name(row), some)
                    some.clear()
            for collection, some in waiting.items():
                if some:
                    act(service, collection, some)

        if gone is not None:
            models = self.tables.read("vectors").join(gone, gone.columns, "left_semi").select("software", "version", "model_hash", "chunk_id")
            models.foreachPartition(lambda part: in_batches(part, lambda s, c, some: s.delete(c, [point({**x, "vector": []})["id"] for x in some])))
        if rows is not None:
            kept = [f.split()[0] for f in SCHEMAS["vectors"].split(", ")]
            rows.select(*kept).foreachPartition(lambda part: in_batches(part, lambda s, c, some: s.upsert(c, [point(x) for x in some])))
        super().write(rows, gone)

    def search(self, vector: Sequence[float], software: str, version: str, model: str, k: int, filters: Mapping | None, metric: str) -> DataFrame:
        """The service's hits (id, score), joined with the record and ordered by score."""
        collection = f"{software}_{version}_{self.tables.spark.range(1).select(ids.model_key(F.lit(model))).first()[0]}"
        hits = [(str(i), float(x)) for i, x in self.connect().search(collection, list(vector), k, self.condition(filters))]
        spark = self.tables.spark
        own = self.read(software, version, model)
        own = own.withColumn("__id", self.service_id(F.col("chunk_id")))
        found = spark.createDataFrame(hits, "__id string, score double")
        return own.join(F.broadcast(found), "__id").drop("__id", "vector").orderBy(F.desc("score"), "chunk_id")

    @staticmethod
    def service_id(chunk_id: Column) -> Column:
        return chunk_id


class QdrantBackend(ServiceBackend):
    """Points under UUIDs made of the chunk's id, with all metadata as payload; filters as `must` conditions."""

    @staticmethod
    def point(row: dict) -> dict:
        out = ServiceBackend.point(row)
        return out | {"id": str(uuid.UUID(hex=(row["chunk_id"].encode().hex() + "0" * 32)[:32])) if len(row["chunk_id"]) < 32 else str(uuid.UUID(row["chunk_id"][:32]))}

    @staticmethod
    def service_id(chunk_id: Column) -> Column:
        h = F.when(F.length(chunk_id) >= 32, F.substring(chunk_id, 1, 32)).otherwise(F.rpad(F.lower(F.hex(F.encode(chunk_id, "utf-8"))), 32, "0"))
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    @staticmethod
    def condition(filters: Mapping[str, Any] | None) -> Any:
        match = lambda v: {"any": list(v)} if isinstance(v, (list, tuple, set)) else {"value": v}
        return {"must": [{"key": k, "match": match(v)} for k, v in filters.items()]} if filters else None


class WeaviateBackend(ServiceBackend):
    """Objects under the first 36 characters of the chunk's id, metadata as properties; filters as one `And`."""

    @staticmethod
    def point(row: dict) -> dict:
        out = ServiceBackend.point(row)
        return {"id": row["chunk_id"][:36], "vector": out["vector"], "properties": out["payload"]}

    @staticmethod
    def service_id(chunk_id: Column) -> Column:
        return F.substring(chunk_id, 1, 36)

    @staticmethod
    def condition(filters: Mapping[str, Any] | None) -> Any:
        one = lambda k, v: {"path": [k], "operator": "ContainsAny" if isinstance(v, (list, tuple, set)) else "Equal", "value": list(v) if isinstance(v, (tuple, set)) else v}
        return {"operator": "And", "operands": [one(k, v) for k, v in filters.items()]} if filters else None


class ChromaBackend(ServiceBackend):
    """Metadata as flat values: lists as JSON text, nulls left out; filters as one `$and`."""

    @staticmethod
    def point(row: dict) -> dict:
        out = ServiceBackend.point(row)
        flat = {k: json.dumps(v) if isinstance(v, list) else v.isoformat() if hasattr(v, "isoformat") else v for k, v in out["payload"].items() if v is not None and k not in ("content", "chunk_id")}
        return {"id": out["id"], "vector": out["vector"], "document": row.get("content"), "payload": flat}

    @staticmethod
    def condition(filters: Mapping[str, Any] | None) -> Any:
        each = [{k: {"$in": list(v)} if isinstance(v, (list, tuple, set)) else {"$eq": v}} for k, v in (filters or {}).items()]
        return each[0] if len(each) == 1 else {"$and": each} if each else None


class LanceBackend(ServiceBackend):
    """Metadata as one JSON text, which decode_metadata() reads; filters as SQL text."""

    @staticmethod
    def point(row: dict) -> dict:
        out = ServiceBackend.point(row)
        return {"id": out["id"], "vector": out["vector"], "payload": {"content": row.get("content"), "metadata": json.dumps(out["payload"], default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))}}

    @staticmethod
    def condition(filters: Mapping[str, Any] | None) -> Any:
        quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
        one = lambda k, v: f"{k} IN ({', '.join(map(quoted, v))})" if isinstance(v, (list, tuple, set)) else f"{k} = {quoted(v)}"
        return " AND ".join(one(k, v) for k, v in filters.items()) if filters else None


BACKENDS: dict[str, type[ParquetBackend]] = {"parquet": ParquetBackend, "qdrant": QdrantBackend, "weaviate": WeaviateBackend, "chroma": ChromaBackend, "lance": LanceBackend, "service": ServiceBackend}


def register(name: str, kind: type[ParquetBackend]) -> None:
    BACKENDS[name] = kind


def backend(name: str, tables: Tables, options: Mapping[str, Any] | None = None) -> ParquetBackend:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](tables, options)
