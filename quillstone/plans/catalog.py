"""Named datasets in layers, with a format and a schema each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources import io

FORMATS = ("parquet", "json", "jsonl", "csv", "text", "memory")


@dataclass(frozen=True)
class Dataset:
    name: str
    layer: str = "raw"
    format: str = "parquet"
    schema: str | None = None
    path: str | None = None  # under the catalog's base, or absolute


@dataclass
class Catalog:
    spark: SparkSession
    base: str
    entries: dict[str, Dataset] = field(default_factory=dict)
    held: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, entry: Dataset) -> Dataset:
        if entry.format not in FORMATS:
            raise ValueError(f"unknown format: {entry.format}")
        if self.entries.get(entry.name, entry) != entry:
            raise ValueError(f"dataset {entry.name} is there with another definition")
        self.entries[entry.name] = entry
        return entry

    def path(self, name: str) -> str:
        e = self.entries[name]
        p = e.path or f"{e.layer}/{name}"
        return p if "://" in p or p.startswith("/") else f"{self.base}/{p}"

    def read(self, name: str) -> DataFrame:
        e = self.entries[name]
        if e.format == "memory":
            if name not in self.held:
                raise KeyError(f"memory dataset {name} has not been written")
            return self.held[name]
        path = self.path(name)
        if e.format == "parquet":
            return (self.spark.read.schema(e.schema) if e.schema else self.spark.read).parquet(path)
        if e.format == "text":
            return io.read_text(self.spark, path)
        if e.schema is None:
            raise ValueError(f"dataset {name} needs a schema")
        return {"json": io.read_json, "jsonl": io.read_json_lines, "csv": io.read_csv}[e.format](self.spark, path, e.schema)

    def write(self, name: str, df: DataFrame) -> None:
        e = self.entries[name]
        if e.format == "memory":
            self.held[name] = df.persist()
        elif e.format == "csv":
            io.write_csv(df, self.path(name))
        elif e.format == "text":
            df.select("text").write.mode("overwrite").text(self.path(name))
        else:
            df.write.mode("overwrite").format("json" if e.format == "jsonl" else e.format).save(self.path(name))

    def views(self) -> None:
        """Every dataset that can be read, as a temporary view of its name."""
        for name in self.entries:
            self.read(name).createOrReplaceTempView(name)
