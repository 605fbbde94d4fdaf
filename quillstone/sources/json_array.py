"""One JSON array in a file of any size, read in many tasks: the file is cut at element boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.sources.io import shared_folder

QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def scan(data: np.ndarray, escaped: bool, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(whether each byte belongs to a string, depth before each byte, depth after it, whether the end is in a string), from the state at the start.

    escaped: a backslash before the first byte escapes it.
    """
    if not len(data):
        return data.astype(bool), data.astype(np.int64), data.astype(np.int64), inside
    slash, at = data == BACKSLASH, np.arange(len(data))
    # a run of backslashes escapes what follows if it is odd; one that a backslash from before escapes starts a byte later
    start = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.where(slash, at - start, 0) - np.where(slash & (start < 0) & escaped, 1, 0)
    odd = np.concatenate([[escaped], run[:-1] % 2 == 1])
    quote = (data == QUOTE) & ~odd
    within = (np.cumsum(quote) + inside) % 2 == 1
    string = within | quote
    step = np.where(string, 0, np.isin(data, (ord("["), ord("{"))).astype(np.int64) - np.isin(data, (ord("]"), ord("}"))))
    after = depth + np.cumsum(step)
    return string, after - step, after, bool(within[-1])


def _trailing(f, offset: int) -> bool:
    """Whether the bytes before the offset end in an odd run of backslashes."""
    count, at = 0, offset
    while at > 0:
        take = min(4096, at)
        f.seek(at - take)
        raw = f.read(take)
        kept = len(raw.rstrip(b"\\"))
        count += take - kept
        if kept:
            break
        at -= take
    return count % 2 == 1


def elements(spark: SparkSession, path: str, chunk: int = 64 << 20) -> DataFrame:
    """number (from 0), value: the elements of the array as texts, written to the shared folder. What isn't one array is an error.

    The first pass sums up each chunk: its quotes and brackets as seen from within a string and from without. A row a chunk goes to the driver, which
    tells the state at each chunk's start. In the second pass a task gives the elements that start in its chunk; one that goes on is read to its end.
    """
    from pyarrow import fs

    system, at = _open(path)
    size = system.get_file_info(at).size
    if system.get_file_info(at).type != fs.FileType.File:
        raise FileNotFoundError(path)
    n = max(1, -(-size // chunk))
    # a task takes many small chunks, or one large one
    chunks = spark.range(0, n, 1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-size // (64 << 20)))))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _open(path)
        for pdf in batches:
            rows = []
            with system.open_input_file(at) as f:
                for i in pdf["id"].tolist():
                    escaped = _trailing(f, i * chunk)
                    f.seek(i * chunk)
                    data = np.frombuffer(f.read(chunk), np.uint8)
                    seen = []
                    for inside in (False, True):
                        _, _, after, last = scan(data, escaped, inside, 0)
                        seen.append((last, int(after[-1]) if len(data) else 0))
                    rows.append((i, escaped, seen[0][0], seen[0][1], seen[1][0], seen[1][1]))
            yield pd.DataFrame(rows, columns=["i", "escaped", "out_in", "out_depth", "in_in", "in_depth"])

    found = sorted(chunks.mapInPandas(summed, "i long, escaped boolean, out_in boolean, out_depth long, in_in boolean, in_depth long").collect())  # a row a chunk
    states, inside, depth = {}, False, 0
    for r in found:
        states[r["i"]] = (r["escaped"], inside, depth)
        inside, depth = (r["in_in"], depth + r["in_depth"]) if inside else (r["out_in"], depth + r["out_depth"])
    if inside or depth:
        raise ValueError(f"{path}: the array doesn't end")
    shared = spark.sparkContext.broadcast(states)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _open(path)
        for pdf in batches:
            with system.open_input_file(at) as f:
                for i in pdf["id"].tolist():
                    yield from _elements(f, i, chunk, size, shared.value[i], path)

    shared_folder(spark)
    made = chunks.mapInPandas(cut, "chunk long, k long, value string").checkpoint()
    counts = sorted(made.groupBy("chunk").agg(F.count("*").alias("n")).collect())  # a row a chunk
    first, total = {}, 0
    for r in counts:
        first[r["chunk"]] = total
        total += r["n"]
    offsets = spark.createDataFrame(list(first.items()) or [(0, 0)], "chunk long, first long")
    return made.join(F.broadcast(offsets), "chunk").select((F.col("first") + F.col("k")).alias("number"), "value")


def _elements(f, i: int, chunk: int, size: int, state: tuple[bool, bool, int], path: str) -> Iterator[pd.DataFrame]:
    """Elements whose separator, the bracket that opens the array or a comma in it, is in the chunk."""
    f.seek(i * chunk)
    raw = f.read(chunk)
    data = np.frombuffer(raw, np.uint8)
    string, before, after, inside = scan(data, *state)
    if i == 0 and not raw.lstrip(b" \t\r\n\xef\xbb\xbf").startswith(b"["):
        raise ValueError(f"{path}: not an array")
    free = ~string
    opens = free & (before == 0) & (after == 1)
    ends = free & (((before == 1) & (after == 0)) | ((before == 1) & (data == COMMA)))
    if (free & (before <= 0) & (after <= 0) & ~np.isin(data, [32, 9, 10, 13, 0xEF, 0xBB, 0xBF])).any() or (after < 0).any() or (i > 0 and opens.any()):
        raise ValueError(f"{path}: something is outside of the array")
    starts = np.flatnonzero(opens | (ends & (data == COMMA)))
    stops = np.flatnonzero(ends)
    rows = []
    for k, s in enumerate(starts.tolist()):
        j = int(np.searchsorted(stops, s, side="right"))
        if j < len(stops):
            value, closed = raw[s + 1 : stops[j]], data[stops[j]] != COMMA
        else:
            value, closed = _rest(f, raw[s + 1 :], (i + 1) * chunk, min(chunk, 1 << 20), size, inside, int(after[-1]), path)
        text = value.strip(b" \t\r\n")
        if not text and data[s] != COMMA and closed:
            continue  # an empty array
        if not text:
            raise ValueError(f"{path}: an element is missing")
        rows.append((i, k, text.decode("utf-8")))
    for at in range(0, len(rows), 4096):
        yield pd.DataFrame(rows[at : at + 4096], columns=["chunk", "k", "value"])


def _rest(f, first: bytes, offset: int, step: int, size: int, inside: bool, depth: int, path: str) -> tuple[bytes, bool]:
    """(value, whether the array ends with it) of an element that goes on after its chunk."""
    parts = [first]
    while offset < size:
        escaped = _trailing(f, offset)
        f.seek(offset)
        more = f.read(step)
        data = np.frombuffer(more, np.uint8)
        string, before, after, inside = scan(data, escaped, inside, depth)
        stop = np.flatnonzero(~string & (((before == 1) & (after == 0)) | ((before == 1) & (data == COMMA))))
        if len(stop):
            return b"".join([*parts, more[: stop[0]]]), bool(data[stop[0]] != COMMA)
        parts.append(more)
        depth, offset = int(after[-1]), offset + len(more)
    raise ValueError(f"{path}: the array doesn't end")


def read(spark: SparkSession, path: str, schema: str, shown: int = 20, preview: int = 500, chunk: int = 64 << 20) -> DataFrame:
    """number and the fields of the schema. If any element doesn't fit, the first few are printed with number, name and a preview, and it is an error."""
    whole = elements(spark, path, chunk)
    full = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    parsed = whole.withColumn("_p", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    bad = parsed.where(broken).select("number", F.get_json_object("value", "$.name").alias("name"), F.substring("value", 1, preview).alias("preview")).orderBy("number").limit(shown).collect()
    for r in bad:
        print(f"element {r['number']} ({r['name'] or 'without a name'}) does not fit: {r['preview']}")
    if bad:
        raise ValueError(f"{path}: element {bad[0]['number']} does not fit the schema")
    return parsed.select("number", *[F.col("_p")[f.name].alias(f.name) for f in full if f.name != "_corrupt_record"])
