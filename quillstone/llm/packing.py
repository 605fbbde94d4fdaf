"""Packing documents into fixed-length token sequences.

First-fit decreasing over a tournament tree of bin capacities, run independently in randomised
groups of documents, so no task ever holds more than a few thousand documents' piece sizes.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import groups_for, prepare, written

END = "<|endoftext|>"


class Encoder:
    """Token ids of a byte-level BPE vocabulary.

    ``tiktoken`` reads the same ranks as the ``tokenizers`` file and is about five times faster;
    the special string is cut out first, because the ``tokenizers`` file maps it to one id.
    A text that ``tiktoken`` can't take (its pattern engine gives up on huge blank runs) goes to ``tokenizers``.
    """

    _kept: dict = {}

    def __init__(self, json_path: str, rank_path: str):
        import public_tokenizers
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path = json_path
        self.end_id = len(ranks)
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    @classmethod
    def get(cls, json_path: str | None = None, rank_path: str | None = None) -> Encoder:
        import public_tokenizers

        key = (json_path or public_tokenizers.path("byte_bpe_50k.json"), rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        if key not in cls._kept:
            cls._kept[key] = cls(*key)
        return cls._kept[key]

    def plain(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the engine's panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if END not in text:
            return self.plain(text)
        ids: list[int] = []
        for k, part in enumerate(text.split(END)):
            if k:
                ids.append(self.end_id)
            if part:
                ids += self.plain(part)
        return ids


class Tournament:
    """Bins of one capacity; the first bin with room is found by descending a tree of maxima."""

    def __init__(self, n: int, capacity: int):
        self.width = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """Index of the leftmost bin with room for size, whose room shrinks by it."""
        best, k = self.best, 1
        while k < self.width:
            k *= 2
            if best[k] < size:
                k += 1
        best[k] -= size
        at = k - self.width
        k >>= 1
        while k:
            left, right = best[2 * k], best[2 * k + 1]
            top = left if left >= right else right
            if best[k] == top:
                break
            best[k] = top
            k >>= 1
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size, largest sizes first; ties keep their order."""
    tree, filled = Tournament(max(1, len(sizes)), capacity), {}
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.place(sizes[i])
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = offsets[i] + sizes[i]
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 2048, separator_id: int = 1, docs_per_group: int = 4096, seed: int = 0,
         json_path: str | None = None, rank_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    A null text is empty, so its document is the separator alone. Every row is a document of its own: repeated
    rows, equal or null doc_ids are packed apart, and other columns are left out. Documents longer than
    the capacity are cut at multiples of it; full pieces are sequences by themselves, every other piece is placed by first-fit
    decreasing in its group. An empty table gives no rows. Sequence ids are unique, not consecutive.
    Pieces are written before they are grouped, so that a task that runs again finds them as they were.
    """
    prepare(docs.sparkSession)
    groups = groups_for(docs.count(), docs_per_group)

    def cut(batches):
        encode = Encoder.get(json_path, rank_path)
        task, row = TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*encode(text or ""), separator_id], dtype="<u4")
                # the group is drawn anew for each row, so copies and equal keys spread over groups
                group = zlib.crc32(b"%d|%d|%d" % (seed, task, row)) % groups
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    raw = part.tobytes()
                    out.append((group, row, doc_id, at, len(part), zlib.crc32(raw), len(ids), part if with_ids else None))
                row += 1
            frame = pd.DataFrame(out, columns=["group", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            frame["task"] = task
            yield frame if with_ids else frame.drop(columns="ids")

    extra = ", ids array<long>" if with_ids else ""
    pieces = written(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        cut, f"group int, row long, doc_id string, start long, length long, ids_crc32 long, doc_tokens long{extra}, task int"
    ))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "row", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), capacity)
        out = pdf.drop(columns=["group", "row", "task"])
        out["sequence_id"] = (int(pdf["group"].iloc[0]) << 32) + np.array(bins, dtype=np.int64)
        out["offset"] = np.array(offsets, dtype=np.int64)
        return out

    placed = pieces.where(F.col("length") < capacity).groupBy("group").applyInPandas(
        place, f"doc_id string, start long, length long, ids_crc32 long, doc_tokens long{extra}, sequence_id long, offset long"
    )
    alone = (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id")  # groups number theirs below
    full = pieces.where(F.col("length") == capacity).select(*placed.columns[:-2], alone, F.lit(0).cast("long").alias("offset"))
    placed = placed.unionByName(full)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))  # text on the way, as pandas turns longs with nulls into floats
