"""A stream of what is added, changed and deleted below a folder."""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, modified timestamp, bytes long, version long"


@dataclass
class Shard(InputPartition):
    version: int
    part: int


class FolderChangesReader(DataSourceStreamReader):
    """An offset is the number of a listing. A listing is written when the folder differs from the last one, dealt by path into shards, so that
    two listings are compared shard by shard in tasks. Spark asks again for a batch that failed, and both its listings are still there."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.state = options["path"], options["state"]
        self.parts, self.ending = int(options.get("parts", "16")), options.get("ending", "")

    def system(self, uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")

    def versions(self) -> list[int]:
        """Listings that were written to the end."""
        from pyarrow import fs

        system, top = self.system(self.state)
        found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
        numbers = [int(f.base_name[8:]) for f in found if f.base_name.startswith("listing-")]
        return sorted(n for n in numbers if system.get_file_info(f"{top}/listing-{n}/_SUCCESS").type == fs.FileType.File)

    def listing(self) -> list[dict[str, tuple[int, int]]]:
        """Of each shard path to (time of change in ns, bytes)."""
        from pyarrow import fs

        system, top = self.system(self.folder)
        shards: list[dict[str, tuple[int, int]]] = [{} for _ in range(self.parts)]
        for f in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            path = posixpath.relpath(f.path, top)
            if f.type == fs.FileType.File and path.endswith(self.ending):
                shards[zlib.crc32(path.encode()) % self.parts][path] = (f.mtime_ns or 0, f.size)
        return shards

    def read_shard(self, version: int, part: int) -> dict[str, tuple[int, int]]:
        import pyarrow.feather as feather

        if version == 0:
            return {}
        system, top = self.system(self.state)
        with system.open_input_file(f"{top}/listing-{version}/{part}.arrow") as f:
            t = feather.read_table(f)
        return dict(zip(t["path"].to_pylist(), zip(t["modified"].to_pylist(), t["bytes"].to_pylist())))

    def write(self, version: int, shards: list[dict[str, tuple[int, int]]]) -> None:
        import pyarrow as pa
        import pyarrow.feather as feather

        system, top = self.system(self.state)
        system.create_dir(f"{top}/listing-{version}", recursive=True)
        for k, files in enumerate(shards):
            paths = sorted(files)
            table = pa.table({"path": pa.array(paths, pa.string()), "modified": pa.array([files[p][0] for p in paths], pa.int64()), "bytes": pa.array([files[p][1] for p in paths], pa.int64())})
            with system.open_output_stream(f"{top}/listing-{version}/{k}.arrow") as out:
                feather.write_feather(table, out, compression="zstd")
        with system.open_output_stream(f"{top}/listing-{version}/_SUCCESS") as out:
            out.write(b"")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        held = self.versions()
        last = held[-1] if held else 0
        now = self.listing()
        if now != [self.read_shard(last, k) for k in range(self.parts)]:
            last += 1
            self.write(last, now)
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Shard(v, k) for v in range(start["version"] + 1, end["version"] + 1) for k in range(self.parts)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        before, now = self.read_shard(partition.version - 1, partition.part), self.read_shard(partition.version, partition.part)
        for path in sorted(before.keys() | now.keys()):
            if before.get(path) != now.get(path):
                kind = "delete" if path not in now else "change" if path in before else "add"
                at, size = now.get(path) or before[path]
                yield path, kind, datetime.fromtimestamp(at / 1e9, timezone.utc), size, partition.version

    def commit(self, end: dict) -> None:
        """Listings before the one that was processed won't be asked for again."""
        system, top = self.system(self.state)
        for n in self.versions():
            if n < end["version"]:
                system.delete_dir(f"{top}/listing-{n}")


class FolderChanges(DataSource):
    """Options: path (the folder), state (a shared folder for listings, of this stream alone), ending (of paths), parts (shards of a listing)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderChangesReader:
        return FolderChangesReader(dict(self.options))


def changes(spark: SparkSession, folder: str, state: str, ending: str = "", parts: int = 16) -> DataFrame:
    """path, kind (add, change or delete), modified, bytes, version: a stream of what differs from one listing of the folder to the next."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=folder, state=state, ending=ending, parts=str(parts)).load()
