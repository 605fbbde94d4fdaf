"""Sources and sinks: typed readers without schema inference."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON arrays or documents as rows. Strict: a bad record is an error; else it fills _corrupt_record."""
    if strict:
        return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
    return spark.read.schema(full.add("_corrupt_record", "string")).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def record_diagnostics(lines: DataFrame, schema: str, preview: int = 500) -> DataFrame:
    """Lines of JSON (value) that don't fit the schema: preview, and name if it can be read."""
    parsed = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("_p", parsed).where("_p._corrupt_record IS NOT NULL").select(
        F.substring("value", 1, preview).alias("preview"), F.get_json_object("value", "$.name").alias("name"))


def checked(spark: SparkSession, path: str, schema: str, shown: int = 20, preview: int = 500) -> DataFrame:
    """Lines of JSON as rows. If any doesn't fit the schema, the first few are printed, with their name and a preview, and it is an error."""
    bad = record_diagnostics(spark.read.text(path), schema, preview).limit(shown).collect()  # `shown` rows at most
    for r in bad:
        print(f"record {r['name'] or 'without a name'} does not fit: {r['preview']}")
    if bad:
        raise ValueError(f"{path}: records that do not fit the schema, {bad[0]['name']} among them")
    return read_json_lines(spark, path, schema)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """path, bytes: every row (path, content as text or binary) as a file below the folder, a shared one.

    Tasks write where the rows are; a task that runs again writes the same files again. It is done when the result is read. Rows that have a
    part as well are one file a path: they are brought together and written one after the other in order of part, so that a file can be larger than a row.
    """
    in_parts = "part" in rows.columns

    def write(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        out, held, size = None, None, 0
        try:
            for pdf in batches:
                done = []
                for path, content in zip(pdf["path"], pdf["content"]):
                    raw = content.encode("utf-8", "surrogatepass") if isinstance(content, str) else bytes(content or b"")
                    if out is None or not in_parts or path != held:
                        if out is not None:
                            out.close()
                            done.append((held, size))
                            out = None
                        whole = posixpath.normpath(posixpath.join(top, path.lstrip("/")))
                        if not whole.startswith(top.rstrip("/") + "/"):
                            raise ValueError(f"{path} leads out of the folder")
                        system.create_dir(posixpath.dirname(whole), recursive=True)
                        out, held, size = system.open_output_stream(whole), path, 0
                    out.write(raw)
                    size += len(raw)
                yield pd.DataFrame(done, columns=["path", "bytes"])
            if out is not None:
                out.close()
                out = None
                yield pd.DataFrame([(held, size)], columns=["path", "bytes"])
        finally:
            if out is not None:
                out.close()

    if in_parts:
        rows = rows.repartition("path").sortWithinPartitions("path", "part")
    return rows.select("path", "content").mapInPandas(write, "path string, bytes long")


def remove_files(rows: DataFrame, folder: str) -> DataFrame:
    """path: files (path) below the folder, taken away where the rows are; one that isn't there is gone already. It is done when the result is read."""

    def unlink(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        for pdf in batches:
            for path in pdf["path"]:
                whole = posixpath.normpath(posixpath.join(top, path.lstrip("/")))
                if not whole.startswith(top.rstrip("/") + "/"):
                    raise ValueError(f"{path} leads out of the folder")
                if system.get_file_info(whole).type == fs.FileType.File:
                    system.delete_file(whole)
            yield pdf[["path"]]

    return rows.select("path").mapInPandas(unlink, "path string")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where no cluster is."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc.getCheckpointDir()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue='""')


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (below the folder), modificationTime, length of all files below a shared folder whose name fits the pattern, listed in tasks, a folder a row.

    Spark's own reader sends the status of each file to the driver, and a plan that names it to the tasks; here both stay in tasks. Names that begin with
    . or _ are left out, as Spark's reader does; empty files, which that leaves out as well, are here.
    """
    shared_folder(spark)
    schema = "path string, modificationTime timestamp, length long, folder boolean"

    def entries(batches):
        import fnmatch

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        top = top.rstrip("/")
        for pdf in batches:
            for path in pdf["path"]:
                found = [f for f in system.get_file_info(fs.FileSelector(f"{top}/{path}".rstrip("/"))) if f.base_name[:1] not in ("_", ".")]
                found = [f for f in found if f.type == fs.FileType.Directory or (f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))]
                for lo in range(0, len(found), 10_000):
                    some = found[lo : lo + 10_000]
                    changed = pd.to_datetime([(f.mtime_ns or 0) // 1000 for f in some], unit="us", utc=True)
                    yield pd.DataFrame({"path": [f.path[len(top) + 1 :] for f in some], "modificationTime": changed, "length": [f.size for f in some], "folder": [f.type == fs.FileType.Directory for f in some]})

    level, out = spark.createDataFrame([("",)], "path string"), None
    while level is not None:
        found = level.repartition("path").mapInPandas(entries, schema).checkpoint()
        out = found if out is None else out.unionByName(found)
        level = found.where("folder").select("path")
        level = level if level.limit(1).count() else None
    return out.where("NOT folder").drop("folder")


def read_files(spark: SparkSession, folder: str, pattern: str = "*", files: DataFrame | None = None) -> DataFrame:
    """path (below the folder), modificationTime, length, content: files below a shared folder (all, or those given), listed and read in tasks."""
    listed = list_files(spark, folder, pattern) if files is None else files

    def read(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        for pdf in batches:
            lo, held, size = 0, [], 0
            for k, path in enumerate(pdf["path"]):
                with system.open_input_stream(f"{top.rstrip('/')}/{path}") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size > 1 << 24 or k + 1 == len(pdf):  # a batch is sent before it is large
                    yield pdf.iloc[lo : k + 1].assign(content=held)
                    lo, held, size = k + 1, [], 0

    dealt = listed.repartition(F.xxhash64("path"))  # files of one folder are listed by one task
    return dealt.select("path", "modificationTime", "length").mapInPandas(read, "path string, modificationTime timestamp, length long, content binary")


def below(path: F.Column, folder: str) -> F.Column:
    """A file's path without that of the folder it was found in."""
    return F.regexp_replace(path, r"^.*?" + r"\Q" + folder.split(":", 1)[-1].rstrip("/") + r"\E/", "")


def glob_files(spark: SparkSession, path: str, pattern: str = "*.md", ignore: tuple[str, ...] = (), rules: str | None = None) -> DataFrame:
    """Paths below a folder by name pattern, without those that an ignore expression or the rules of an ignore file leave out, sorted."""
    from quillstone.sources.ignore import ignored

    found = read_binary(spark, path, pattern).select("path", "length", "modificationTime")
    for x in ignore:
        found = found.where(~F.col("path").rlike(x))
    if rules is not None:
        found = found.where(~ignored(below(F.col("path"), path), rules))
    return found.orderBy("path")


def front_matter(text: F.Column) -> F.Column:
    """struct(fields map, body): simple key: value lines between leading --- or +++ fences."""
    head = F.regexp_extract(text, r"(?s)^(?:---|\+\+\+)\r?\n(.*?)\r?\n(?:---|\+\+\+)(?:\r?\n|$)", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*[:=]"))
    entries = F.transform(pairs, lambda x: F.struct(
        F.regexp_extract(x, r"^([\w-]+)", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[\w-]+\s*[:=]", "")), "^[\"']|[\"']$", "").alias("value")))
    body = F.regexp_replace(text, r"(?s)^(?:---|\+\+\+)\r?\n.*?\r?\n(?:---|\+\+\+)(?:\r?\n|$)", "")
    # of a key given twice, the last value counts
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda z: z["key"] == e["key"])) == 0)
    return F.struct(F.map_from_entries(last).alias("fields"), body.alias("body"))


def strip_data_prefix(image: F.Column) -> F.Column:
    """Bytes of a data: URL."""
    return F.unbase64(F.regexp_replace(image, r"^data:[^,]*,", ""))
