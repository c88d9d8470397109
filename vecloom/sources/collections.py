"""The catalog of collections: one JSON file each, created if absent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from vecloom.model import COLLECTION_NAME, Config
from vecloom.sources.store import Files, Store

SCHEMA = "name string, dimensions int, metric string, resident_key string, resident_value string, routed_keys array<string>, generation int"


class Conflict(ValueError):
    pass


class Collections:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _load(self, name: str) -> dict | None:
        found = [n for n in self.files.names(f"catalog/{name}") if n.endswith(".json")] if COLLECTION_NAME.fullmatch(name) else []
        entry = json.loads(self.files.read(f"catalog/{name}/{found[-1]}")) if found else None
        return entry

    def create(self, config: Config) -> dict:
        """Idempotent for an equal configuration; another one of the same name is a conflict."""
        wanted = {"name": config.name, "dimensions": config.dimensions, "metric": str(config.metric), "resident_filter": list(config.resident_filter) if config.resident_filter else None, "routed_keys": list(config.routed_keys)}
        found = self._load(config.name)
        if found and not found.get("deleted"):
            if {k: found[k] for k in wanted} != wanted:
                raise Conflict(f"{config.name} exists with another configuration")
            return found
        generation = (found["generation"] if found else 0) + 1
        entry = wanted | {"generation": generation, "deleted": False}
        self.files.create(f"catalog/{config.name}/{generation:010d}-a.json", json.dumps(entry))
        return entry

    def get(self, name: str) -> dict | None:
        found = self._load(name)
        return None if found is None or found.get("deleted") else found

    def delete(self, name: str) -> bool:
        found = self.get(name)
        if found:
            self.files.create(f"catalog/{name}/{found['generation']:010d}-b.json", json.dumps(found | {"deleted": True}))
        return bool(found)

    def names(self) -> list[str]:
        return [n for n in self.files.names("catalog") if self.get(n)]

    def table(self) -> DataFrame:
        rows = []
        for e in map(self.get, self.names()):
            key, value = e["resident_filter"] or (None, None)
            rows.append((e["name"], e["dimensions"], e["metric"], key, value, e["routed_keys"], e["generation"]))
        return self.spark.createDataFrame(rows, SCHEMA)

    def open(self, name: str) -> Store:
        e = self.get(name)
        if e is None:
            raise KeyError(name)
        resident = tuple(e["resident_filter"]) if e["resident_filter"] else None
        config = Config(e["dimensions"], e["metric"], name, resident, tuple(e["routed_keys"]))
        return Store(self.spark, f"{self.root}/data/{name}/{e['generation']}", config)

    def sweep(self) -> list[str]:
        """Removes the data of deleted collections and of earlier generations."""
        gone = []
        for name in self.files.names("data"):
            e = self.get(name)
            for generation in self.files.names(f"data/{name}"):
                if e is None or int(generation) != e["generation"]:
                    gone.append(f"data/{name}/{generation}")
        for g in gone:
            self.files.remove(g)
        return gone
