"""Best-fit packing of whole documents by a grouping genetic algorithm.

Documents are dealt at random into groups of a bounded size. Each group is a problem with some islands: populations of packings that evolve
apart, each in its own row of a table, and pass their best packing to the next island between epochs. What the best packing leaves in
poorly filled sequences is dealt into groups once more and packed together.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import groups_for, partitions, prepare, written


#: The sign that byte-level vocabularies write for each byte: itself if it is a printable one of Latin-1, else the next beyond them.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_SIGNS = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}


class WordEncoder:
    """Token ids, as bytes of four each, of a BPE vocabulary with word ends, as the `tokenizers` file gives them.

    Such a vocabulary encodes each piece of the pre-tokenizer's pattern by itself, and no piece goes across white space. So words between
    white space that were met before are looked up, and pieces of new ones go to the model of `tokenizers`. Texts with other characters than plain white space, printable ASCII and Latin letters, on which pattern engines
    could differ, and texts that may hold special tokens go to `tokenizers` whole.
    """

    _kept: dict = {}
    LAST = 0x24F
    PLAIN = re.compile(f"[\t\n\r\x20-\x7e\xa1-{chr(LAST)}]*\\Z")

    def __init__(self, json_path: str, most_known: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores
        self.full = Tokenizer.from_file(json_path)
        self.model = self.full.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.full.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most_known = most_known
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x21, self.LAST + 1) if unicodedata.category(chr(c))[0] == kind)
        letter, number = of("L"), of("N")
        # the pieces of the file's own pattern, over the characters of PLAIN
        self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall

    @classmethod
    def get(cls, json_path: str | None = None) -> WordEncoder:
        import public_tokenizers

        path = json_path or public_tokenizers.path("word_bpe_49k.json")
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Ids of words between white space: their pieces, each looked up or encoded by the model, which takes bytes as the signs that stand for them."""
        known, parts, tokenize, ids_of = self.known, self.parts, self.model.tokenize, self.id_bytes
        for w in words:
            made = []
            for p in (w,) if w.isascii() and w.isalpha() else self.pieces(w):
                found = parts.get(p)
                if found is None:
                    signs = p if p.isascii() else "".join(map(BYTE_SIGNS.__getitem__, p.encode()))
                    found = parts[p] = b"".join([ids_of[t.id] for t in tokenize(signs)])
                made.append(found)
            known[w] = b"".join(made)

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text."""
        known, get = self.known, self.known.__getitem__
        for text in texts:
            if "<|" in text or not self.PLAIN.match(text):
                yield self.whole(text)
                continue
            words = text.lower().split()
            new = [w for w in set(words) if w not in known]
            if len(known) + len(new) > self.most_known:
                known.clear()
                self.parts.clear()
                new = list(set(words))
            self.learn(new)
            yield b"".join(map(get, words))


class Rooms:
    """Bins by the room they have left; the best fit is the least room of enough, found in a bit set of the rooms in use."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def add(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.used |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, room before) of the best fit, which leaves the set; None if no bin has room."""
        fits = self.used >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        bins = self.by_room[room]
        b = bins.pop()
        if not bins:
            self.used &= ~(1 << room)
        return b, room


def best_fit(sizes: list[int], order: list[int], assigned: list[int], load: list[int], capacity: int) -> None:
    """Place the items of `order`, one by one, in the bin that they fill best; new bins are appended to load."""
    rooms = Rooms(capacity)
    for b, filled in enumerate(load):
        if filled < capacity:
            rooms.add(b, capacity - filled)
    for i in order:
        size = sizes[i]
        found = rooms.take(size)
        if found is None:
            b, room = len(load), capacity
            load.append(0)
        else:
            b, room = found
        load[b] += size
        assigned[i] = b
        if room > size:
            rooms.add(b, room - size)


def fitness(assigned: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """(bins, minus the sum of squared fills): fewer bins are better, then room gathered in few of them."""
    load = np.bincount(assigned, weights=sizes)
    return len(load), -float((load * load).sum() / capacity**2)


def placed_again(kept: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A packing from a partial one (-1: displaced): bins are numbered anew and displaced items best-fitted, large ones first."""
    here = kept >= 0
    _, numbers = np.unique(kept[here], return_inverse=True)
    out = np.full(len(kept), -1, dtype=np.int64)
    out[here] = numbers
    load = np.bincount(numbers, weights=sizes[here]).astype(np.int64).tolist() if len(numbers) else []
    loose = np.flatnonzero(~here)
    loose = loose[np.lexsort((rng.random(len(loose)), -sizes[loose]))]
    filled = out.tolist()
    best_fit(sizes.tolist(), loose.tolist(), filled, load, capacity)
    return np.array(filled, dtype=np.int64)


def crossed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with whole well-filled bins of b: bins of a that hold any of their items are dissolved, and what is displaced is best-fitted."""
    load = np.bincount(b, weights=sizes)
    well = np.flatnonzero(load >= np.quantile(load, 0.5))
    chosen = np.zeros(len(load), dtype=bool)
    chosen[well[rng.random(len(well)) < rng.uniform(0.1, 0.5)]] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, dtype=bool)
    broken[a[injected]] = True
    child = np.where(broken[a], -1, a)
    child[injected] = b[injected] + len(broken)
    return placed_again(child, sizes, capacity, rng)


def mutated(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with its least filled bins and some others dissolved."""
    load = np.bincount(a, weights=sizes)
    gone = np.zeros(len(load), dtype=bool)
    gone[np.argsort(load)[: 1 + int(rng.integers(3))]] = True
    gone |= rng.random(len(load)) < 3 / len(load)
    return placed_again(np.where(gone[a], -1, a), sizes, capacity, rng)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer: the total, and items over half of the capacity with those that fit beside none of them."""
    big = sizes[sizes * 2 > capacity]
    bound = -(-int(sizes.sum()) // capacity)
    for least in np.unique(sizes[sizes * 2 <= capacity])[:64]:
        alone = big[big + least > capacity]
        rest = big[big + least <= capacity]
        small = sizes[(sizes * 2 <= capacity) & (sizes >= least)]
        over = int(small.sum()) - int((capacity - rest).sum())
        bound = max(bound, len(alone) + len(rest) + max(0, -(-over // capacity)))
    return max(bound, len(big))


def evolve(sizes: np.ndarray, people: list[np.ndarray], capacity: int, population: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first; a missing one starts with best fit of random orders, and one of falling sizes."""
    while len(people) < population:
        noise = rng.random(len(sizes)) if people else None
        order = np.argsort(noise, kind="stable") if people else np.argsort(-sizes, kind="stable")
        assigned, load = [-1] * len(sizes), []
        best_fit(sizes.tolist(), order.tolist(), assigned, load, capacity)
        people.append(np.array(assigned, dtype=np.int64))
    ranked = sorted(((fitness(p, sizes, capacity), k) for k, p in enumerate(people)), key=lambda f: f)
    people, marks = [people[k] for _, k in ranked], [f for f, _ in ranked]
    bound, total = least_bins(sizes, capacity), int(sizes.sum())
    # all bins full but one: no packing is better
    ideal = -float((total // capacity) + ((total % capacity) / capacity) ** 2)
    for _ in range(generations):
        if marks[0][0] <= bound and marks[0][1] <= ideal + 1e-12:
            break
        a, b = (min(int(rng.integers(len(people))), int(rng.integers(len(people)))) for _ in range(2))
        for child in (crossed(people[a], people[b], sizes, capacity, rng) if a != b else mutated(people[a], sizes, capacity, rng), mutated(people[0], sizes, capacity, rng)):
            mark = fitness(child, sizes, capacity)
            if mark in marks:  # a packing as good is there
                continue
            at = next((k for k, m in enumerate(marks) if mark < m), None)
            if at is not None:
                people.insert(at, child)
                marks.insert(at, mark)
                people.pop()
                marks.pop()
    return people


def packed_groups(pieces: DataFrame, capacity: int, per_group: int, islands: int, population: int, generations: int, epochs: int, seed: int) -> DataFrame:
    """group, keys, sizes, bins: the best packing of each random group of pieces (key, length); one row a group, of about per_group pieces."""
    spark = pieces.sparkSession
    groups = groups_for(pieces.count(), per_group)
    parts = max(partitions(spark), min(groups * islands, 20_000))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        return pd.DataFrame({"group": [int(pdf["group"].iloc[0])], "keys": [pdf["key"].tolist()], "sizes": [pdf["length"].tolist()]})

    dealt = pieces.select("key", "length", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups)).alias("group"))
    rows = written(dealt.groupBy("group").applyInPandas(gather, "group long, keys array<long>, sizes array<int>"))
    state = "group long, island int, sizes array<int>, people array<array<int>>, bins int, slack double"

    def step(epoch: int):
        def run(batches):
            for pdf in batches:
                for group, island, sizes, people in zip(pdf["group"], pdf["island"], pdf["sizes"], pdf["people"]):
                    sizes = np.asarray(sizes, dtype=np.int64)
                    held = [np.asarray(p, dtype=np.int64) for p in (people if people is not None else [])]
                    best = evolve(sizes, held, capacity, population, generations, np.random.default_rng([seed, int(group), int(island), epoch]))
                    mark = fitness(best[0], sizes, capacity)
                    yield pd.DataFrame({"group": [group], "island": [island], "sizes": [sizes.astype(np.int32)], "people": [[p.astype(np.int32) for p in best]], "bins": [mark[0]], "slack": [mark[1]]})

        return run

    now = rows.select("group", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.lit(None).cast("array<array<int>>").alias("people"))
    for epoch in range(epochs):
        if epoch:  # each island's best takes the place of the next one's worst
            guests = now.select("group", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("people")[0].alias("guest"))
            joined = now.join(guests, ["group", "island"])
            own = F.when(F.array_contains("people", F.col("guest")), F.col("people")).otherwise(F.concat(F.slice("people", 1, population - 1), F.array("guest")))
            now = joined.select("group", "island", "sizes", own.alias("people"))
        now = written(now.repartition(parts, "group", "island").mapInPandas(step(epoch), state))
    best = now.groupBy("group").agg(F.min_by(F.col("people")[0], F.struct("bins", "slack", "island")).alias("bins"))  # a row an island
    return rows.join(best, "group")


def pack(docs: DataFrame, capacity: int = 2048, separator_id: int = 0, per_group: int = 4096, islands: int = 3, population: int = 6, generations: int = 12,
         epochs: int = 2, well_filled: float = 0.998, seed: int = 0, json_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, so its document is the separator alone. Every row is a document of its own: repeated rows, equal or null doc_ids are
    packed apart, and other columns are left out, whatever their names. Only documents longer than the capacity are cut, at multiples of it.
    Full pieces are sequences by themselves; all others go through the genetic algorithm, twice if their sequence stays filled below
    well_filled. Sequence ids are unique, not consecutive. Pieces are written before they are dealt, so that a task that runs again
    finds them as they were. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)

    def cut(batches):
        encoder = WordEncoder.get(json_path)
        task, row, end = TaskContext.get().partitionId(), 0, np.array([separator_id], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, ids in zip(pdf["doc_id"], encoder.many(t or "" for t in pdf["text"])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at : at + 4 * capacity]
                    out.append(((task << 38) + row, doc_id, k, at // 4, len(raw) // 4, zlib.crc32(raw)))
                    row += 1
            yield pd.DataFrame(out, columns=["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    pieces = written(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        cut, "key long, doc_id string, piece int, start long, length int, ids_crc32 long"
    ))  # doc_id is text on the way, as pandas turns longs with nulls into floats

    def number(level: int):
        def run(batches):
            for pdf in batches:
                for group, keys, sizes, bins in zip(pdf["group"], pdf["keys"], pdf["sizes"], pdf["bins"]):
                    sizes, bins = np.asarray(sizes, dtype=np.int64), np.asarray(bins, dtype=np.int64)
                    order = np.argsort(bins, kind="stable")
                    ends = np.cumsum(sizes[order])
                    load = np.bincount(bins, weights=sizes).astype(np.int64)
                    first = np.r_[0, np.cumsum(load)[:-1]]
                    yield pd.DataFrame({
                        "key": np.asarray(keys)[order], "length": sizes[order].astype(np.int32), "sequence_id": (level << 60) + (int(group) << 20) + bins[order],
                        "offset": ends - sizes[order] - first[bins[order]], "filled": load[bins[order]],
                    })

        return run

    def place(some: DataFrame, level: int, **kw) -> DataFrame:
        found = packed_groups(some, capacity, per_group, islands, population, generations, epochs, seed + level)
        return written(found.mapInPandas(number(level), "key long, length int, sequence_id long, offset long, filled long"))

    once = place(pieces.where(F.col("length") < capacity).select("key", "length"), 0)
    poor = F.col("filled") < well_filled * capacity
    again = place(once.where(poor).select("key", "length"), 1)
    places = once.where(~poor).unionByName(again).select("key", "sequence_id", "offset")
    shown = [F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32"]
    whole = pieces.where(F.col("length") == capacity).select(*shown, (F.col("key") + F.lit(2 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(places, "key").select(*shown, "sequence_id", "offset").unionByName(whole)
