"""Removal of byte strings that occur more than once in a corpus, with suffix arrays.

A corpus-wide suffix array isn't built in one piece. Each window of `length` bytes belongs to the smallest hash
of the 64-byte strings in it, so equal windows meet under one hash. Consecutive windows of one hash form a run. Runs
whose hash is met only once hold no repeat and go no further. The distinct strings of the others are dealt out by hash, and
each share of them is put into a suffix array by two-stage sorting: suffixes smaller than their successor
are sorted directly, the rest are induced by scanning buckets of first bytes; common prefixes of neighbours
then tell the windows that occur again.

A hash with too many distinct strings for one task (a passage in a third of all documents, each time between other texts)
is refined: its windows go by longer and longer content keys, minima of further hash functions over their 64-byte strings and
in the end all of their bytes. Equal windows have equal keys, so they still meet; strings within the passage become equal and
collapse, those that reach far out of it are met once and go, and only the few windows at its edges are refined again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, parted, partitions, prepare, release, shared_dir, written
from quillstone.llm.jaccardforest import words

GRAM = 64
#: Minima in the content keys that a hot hash is refined by, one after the other; 0 is the whole window.
KEYS = (4, 32, 0)
#: Bytes that stand for a word where windows are counted in words.
WIDE = 6
#: Positions a text is scanned by at a time, so that very long texts need no more memory.
SEGMENT = 1 << 18
#: Bytes of strings in one suffix array.
BATCH = 1 << 19

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def coded(data: bytes) -> bytes:
    """WIDE bytes of hash for each word, so that windows of words are windows of bytes; white space has no part in them."""
    return words(np.frombuffer(data, dtype=np.uint8))[2].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes from every position, by doubling; empty if there are fewer."""
    h = _BYTE[raw]
    n = 1
    while n < GRAM:
        h = h[: len(h) - n] * _power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every window of that width."""
    n, out = 1, x
    while 2 * n <= width:
        out = best(out[:-n], out[n:])
        n *= 2
    return best(out[: len(out) - (width - n)], out[width - n :]) if width > n else out


def runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start, whether the hash is met twice within) of each run of windows."""
    width = length - GRAM + 1
    out = []
    for at in range(0, max(len(raw) - length + 1, 0), SEGMENT):
        h = gram_hashes(raw[at : at + SEGMENT + length - 1])
        low = sliding(h, width, np.minimum)
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        last = np.concatenate((first[1:], [len(low)])) - 1
        value = low[first]
        # places of minima: where the largest minimum of the windows around is the place's own hash
        padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
        places = np.flatnonzero(sliding(padded, width, np.maximum) == h)
        a, b = np.searchsorted(places, first), np.searchsorted(places, last + width)
        total = b - a
        owner = np.repeat(np.arange(len(first)), total)
        item = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total) + np.repeat(a, total)
        met = np.bincount(owner, weights=h[places[item]] == value[owner], minlength=len(first))
        out.append((value, first + at, last + at, met >= 2))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_order(strings: list[bytes], wanted: list[int], depth: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(sorted suffixes, common prefixes with the one before, all bytes) of the first `wanted` starts of each string.

    Order and prefixes are exact to depth bytes; suffixes end with their string. The bytes of the strings stand one
    after the other. Two-stage sorting: a suffix is small if it is less than its successor.
    """
    data = b"".join(strings)
    text = np.frombuffer(data, dtype=np.uint8)
    n = len(text)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    # a suffix is small if the first byte that differs from its successor's is the smaller one; the end is the least byte
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[stops - 1] = -1
    change = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(change[::-1])[::-1]
    small = step[following] > 0
    # starts that matter: the wanted ones, and beyond them up to the next small one, from which the last are induced
    next_small = np.where(small, np.arange(n), n)
    next_small = np.minimum.accumulate(next_small[::-1])[::-1]
    reach = np.minimum(next_small[np.minimum(begins + np.array(wanted, dtype=np.int64) - 1, n - 1)], stops - 1)
    used = np.zeros(n + 1, np.int32)
    np.add.at(used, begins, 1)
    np.add.at(used, reach + 1, -1)
    used = np.cumsum(used)[:n] > 0
    stop_of = np.repeat(stops, sizes)

    direct = np.flatnonzero(small & used)
    ends = np.minimum(direct + depth, stop_of[direct])
    heads = [data[a:b] for a, b in zip(direct.tolist(), ends.tolist())]
    direct = direct[sorted(range(len(heads)), key=heads.__getitem__)] if heads else direct
    del heads

    # buckets by first byte: induced suffixes come first, as they are smaller than the small ones of the same byte
    by_byte: list[list[np.ndarray]] = [[] for _ in range(256)]
    firsts = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    lone = stops - 1
    lone = lone[used[lone] & ~small[lone]]
    for c, at in zip(text[lone].tolist(), lone.tolist()):
        by_byte[c].append(np.array([at]))
    is_begin = np.zeros(n + 1, bool)
    is_begin[begins] = True
    out: list[np.ndarray] = []
    for c in range(256):
        queue = by_byte[c]
        k = 0
        small_done = False
        while k < len(queue) or not small_done:
            if k < len(queue):
                if k + 1 < len(queue):  # all that is known by now, in order
                    merged = np.concatenate(queue[k:])
                    del queue[k:]
                    queue.append(merged)
                scan = queue[k]
                k += 1
            else:
                scan, small_done = direct[firsts[c] : firsts[c + 1]], True
            if not len(scan):
                continue
            out.append(scan)
            before = scan[~is_begin[scan]] - 1
            before = before[used[before] & ~small[before]]
            if len(before):
                byte = text[before]
                order = np.argsort(byte, kind="stable")
                before, byte = before[order], byte[order]
                cuts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1]))).tolist() + [len(byte)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    by_byte[int(byte[a])].append(before[a:b])
    suffixes = np.concatenate(out) if out else np.zeros(0, np.int64)
    return suffixes, common_prefixes(text, suffixes, stop_of, depth), data


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, stop_of: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, depth at most, that each suffix shares with the one before it; eight are compared at a time."""
    m = len(suffixes)
    shared = np.zeros(m, np.int64)
    if m < 2:
        return shared
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    room = np.minimum(np.minimum(stop_of[suffixes[1:]] - suffixes[1:], stop_of[suffixes[:-1]] - suffixes[:-1]), depth)
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    active = np.arange(m - 1)
    at = 0
    while len(active) and at < depth:
        x = words[suffixes[active + 1] + at].copy().view(np.uint64).ravel()
        y = words[suffixes[active] + at].copy().view(np.uint64).ravel()
        differ = x != y
        if differ.any():
            rows = active[differ]
            low = (x[differ] ^ y[differ]).view(np.uint8).reshape(-1, 8) != 0
            shared[rows + 1] = at + low.argmax(1)
        active = active[~differ]
        at += 8
        shared[active + 1] = at
        active = active[room[active] > at]
    shared[1:] = np.minimum(shared[1:], room)
    return shared


def repeated_windows(strings: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """Of each string, which window starts occur again in total."""
    counts = [len(s) - length + 1 for s in strings]
    suffixes, shared, _ = suffix_order(strings, counts, length)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    owner_of = np.repeat(np.arange(len(strings)), sizes)
    owner = owner_of[suffixes]
    start = suffixes - begins[owner]
    group = np.cumsum(shared < length)  # neighbours with a whole window in common stand together
    whole = start < np.array(counts)[owner]
    owner, start, group = owner[whole], start[whole], group[whole]
    total = np.bincount(group, weights=np.array(weights, dtype=float)[owner])
    again = total[group] >= 2
    flags = [np.zeros(c, bool) for c in counts]
    for i, s in zip(owner[again].tolist(), start[again].tolist()):
        flags[i][s] = True
    return flags


def spans(flags: np.ndarray, begin: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the flagged windows."""
    if not flags.any():
        return []
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    out: list[tuple[int, int]] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        lo, hi = begin + a, begin + b - 1 + length
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def content_keys(raw: np.ndarray, length: int, minima: int) -> np.ndarray:
    """A key of each window of the bytes: the same for equal windows, and with more minima the same for fewer windows around."""
    if minima == 0:
        data = raw.tobytes()
        return np.array([xxhash.xxh3_64_intdigest(data[i : i + length]) for i in range(len(raw) - length + 1)], dtype=np.uint64)
    h = gram_hashes(raw)
    width = length - GRAM + 1
    factors = np.random.default_rng(minima).integers(1, 1 << 63, (minima, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = np.zeros(len(h) - width + 1, np.uint64)
    for a, b in factors:
        x = h * a + b
        x ^= x >> np.uint64(29)
        key = (key ^ sliding(x, width, np.minimum)) * _B
        key ^= key >> np.uint64(32)
    return key


def finer_runs(data: bytes, length: int, minima: int) -> list[tuple[int, int, int, bool]]:
    """(key, first start, last start, whether a window may be met twice within) of each run of windows of one key."""
    raw = np.frombuffer(data, dtype=np.uint8)
    key = content_keys(raw, length, minima)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.concatenate((first[1:], [len(key)])) - 1
    h = np.sort(gram_hashes(raw))
    again = bool((h[1:] == h[:-1]).any())
    return [(k, a, b, again and b > a) for k, a, b in zip(key[first].tolist(), first.tolist(), last.tolist())]


def _signed(x: int) -> int:
    return x - (1 << 63)


def _known(strings: DataFrame) -> DataFrame:
    """hash, string, copies and of the hash: met, strings, again, least; of the strings (with copies and twice) whose hash may hold a repeat."""
    hashes = strings.groupBy("hash").agg(F.sum("copies").alias("met"), F.count("*").alias("strings"), F.max("twice").alias("again"), F.min("copies").alias("least"))
    return strings.drop("twice").join(hashes.where("met >= 2 OR again"), "hash")


#: A string met twice repeats as a whole; these, the others and one of each that they may share windows with, are compared.
UNSETTLED = "again OR (strings > 1 AND least = 1)"


def _picked(repeated: DataFrame, *names: str) -> DataFrame:
    """The unsettled strings, once each; names are the columns besides the key that say where a string is."""
    held = repeated.where(UNSETTLED)
    place = ["key_a", "key_b", "first", "last", *names]
    single = held.where("copies = 1").select("hash", "string", *place, "copies", "strings")
    # one of the equal strings stands for all: the one of the least key
    stands = held.where("copies >= 2").groupBy("hash", "string").agg(F.min(F.struct(*place)).alias("m"), F.first("copies").alias("copies"), F.first("strings").alias("strings"))
    return single.unionByName(stands.select("hash", "string", "m.*", "copies", "strings"))


STRING = "hash long, strings long, key_a long, key_b long, first long, copies long, data binary"


def repeats(docs: DataFrame, length: int = 400, strings_per_task: int = 2048, by_word: bool = False) -> DataFrame:
    """key_a, key_b, ranges of each distinct text with any; the key is a hash of the text.

    Ranges are those of bytes that repeat. With by_word, length is a number of words, and ranges are those of coded(). A hash of more than
    strings_per_task distinct strings is refined.
    """
    least = 2 * length - 1 if by_word else length
    length = length * WIDE if by_word else length
    own = coded if by_word else bytes
    spark = docs.sparkSession
    prepare(spark, 256)
    shared_dir(spark)
    n = partitions(spark)
    key = [F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b")]
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= least).select(*key, "doc_id", "text")

    def emit(batches):
        for pdf in batches:
            parts = []
            for a, b, doc_id, text in zip(pdf["key_a"], pdf["key_b"], pdf["doc_id"], pdf["text"]):
                data = own(text.encode("utf-8", "surrogatepass"))
                value, first, last, twice = runs(np.frombuffer(data, dtype=np.uint8), length)
                ends = (last + length).tolist()
                sub = np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(first.tolist(), ends)], dtype=np.uint64)
                parts.append(pd.DataFrame({"key_a": a, "key_b": b, "doc_id": [doc_id] * len(first), "hash": value.view(np.int64), "string": sub.view(np.int64), "first": first, "last": last, "twice": twice}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["key_a", "key_b", "doc_id", "hash", "string", "first", "last", "twice"])

    # one row a run; the texts stay behind
    found = written(texts.mapInPandas(emit, "key_a long, key_b long, doc_id string, hash long, string long, first long, last long, twice boolean"))
    # most runs have a hash that is met once; they are left behind before whole rows are shuffled
    met = written(found.groupBy("hash").agg(F.count("*").alias("met"), F.max("twice").alias("again")).where("met >= 2 OR again").select("hash"))
    found = parted(found, "hash", met)[0]
    strings = found.groupBy("hash", "string").agg(F.count("*").alias("copies"), F.max("twice").alias("twice"))
    repeated = found.drop("twice").join(_known(strings), ["hash", "string"]).checkpoint()
    whole = repeated.where("copies >= 2").select("key_a", "key_b", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    wanted = F.collect_list(F.struct("hash", "strings", "first", "last", "copies")).alias("runs")
    asked = written(_picked(repeated, "doc_id").groupBy("key_a", "key_b", F.col("doc_id").alias("_d")).agg(wanted))
    texts = parted(texts, "key_a", asked)[0]

    def cut(batches):
        for pdf in batches:
            out = []
            for a, b, text, runs_ in zip(pdf["key_a"], pdf["key_b"], pdf["text"], pdf["runs"]):
                data = own(text.encode("utf-8", "surrogatepass"))
                out += [(r["hash"], r["strings"], a, b, r["first"], r["copies"], data[r["first"] : r["last"] + length]) for r in runs_]
            yield pd.DataFrame(out, columns=["hash", "strings", "key_a", "key_b", "first", "copies", "data"])

    # a string is cut out of one document; repeated rows send it again, which sort() passes over
    same = (texts["key_a"] == asked["key_a"]) & (texts["key_b"] == asked["key_b"]) & texts["doc_id"].eqNullSafe(asked["_d"])
    cut_out = texts.join(asked, same).select(texts["key_a"], texts["key_b"], "text", "runs").mapInPandas(cut, STRING)
    hot = F.col("strings") > strings_per_task
    if repeated.where(UNSETTLED).where(hot).isEmpty():
        ready = cut_out
    else:
        ready, finer = _refined(written(cut_out), length, strings_per_task)
        whole = whole.unionByName(finer)
    dealt = ready.repartition(n, "hash").sortWithinPartitions("hash", "key_a", "key_b", "first")

    def sort(batches):
        held: list[tuple] = []
        size = 0
        for pdf in batches:
            for row in zip(pdf["hash"], pdf["key_a"], pdf["key_b"], pdf["first"], pdf["copies"], pdf["data"]):
                if held and size >= BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                if held and row[:4] == held[-1][:4]:
                    continue  # the same place of an equal text
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)
        release()

    def solve(held: list[tuple]) -> pd.DataFrame:
        flags = repeated_windows([r[5] for r in held], [int(r[4]) for r in held], length)
        rows = [(r[1], r[2], lo, hi) for r, f in zip(held, flags) for lo, hi in spans(f, int(r[3]), length)]
        return pd.DataFrame(rows, columns=["key_a", "key_b", "lo", "hi"]).astype("int64")

    near = dealt.mapInPandas(sort, "key_a long, key_b long, lo long, hi long")
    return whole.unionByName(near).groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))


def _refined(strings: DataFrame, length: int, strings_per_task: int) -> tuple[DataFrame, DataFrame]:
    """(strings as STRING of which none has a hot hash, ranges that repeat as a whole) of strings as STRING.

    Strings go on by each of KEYS while their hash is hot. By whole windows, all strings of a hash are repetitions of one byte run
    or single windows, so nothing is left to part.
    """
    hot = F.col("strings") > strings_per_task
    ready, whole, hotter = strings.where(~hot), None, strings.where(hot)
    for minima in KEYS:
        if hotter.isEmpty():
            break

        def name(batches, minima=minima):
            for pdf in batches:
                out = []
                for h, a, b, at, copies, data in zip(pdf["hash"], pdf["key_a"], pdf["key_b"], pdf["first"], pdf["copies"], pdf["data"]):
                    seed = h & (1 << 64) - 1
                    for value, first, last, twice in finer_runs(data, length, minima):
                        own = xxhash.xxh3_64_intdigest(value.to_bytes(8, "little"), seed=seed)
                        out.append((_signed(own), _signed(xxhash.xxh3_64_intdigest(data[first : last + length])), a, b, at, at + first, at + last, copies, twice))
                yield pd.DataFrame(out, columns=["hash", "string", "key_a", "key_b", "origin", "first", "last", "n", "twice"])

        found = written(hotter.mapInPandas(name, "hash long, string long, key_a long, key_b long, origin long, first long, last long, n long, twice boolean"))
        known = _known(found.groupBy("hash", "string").agg(F.sum("n").alias("copies"), F.max("twice").alias("twice")))
        repeated = found.drop("twice", "n").join(known, ["hash", "string"]).checkpoint()
        ranges = repeated.where("copies >= 2").select("key_a", "key_b", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
        whole = ranges if whole is None else whole.unionByName(ranges)
        wanted = F.collect_list(F.struct("hash", "strings", "first", "last", "copies")).alias("runs")
        asked = _picked(repeated, "origin").groupBy("key_a", "key_b", "origin").agg(wanted)

        def cut(batches):
            for pdf in batches:
                out = []
                for a, b, at, data, runs_ in zip(pdf["key_a"], pdf["key_b"], pdf["origin"], pdf["data"], pdf["runs"]):
                    out += [(r["hash"], r["strings"], a, b, r["first"], r["copies"], data[r["first"] - at : r["last"] - at + length]) for r in runs_]
                yield pd.DataFrame(out, columns=["hash", "strings", "key_a", "key_b", "first", "copies", "data"])

        again = hotter.select("key_a", "key_b", F.col("first").alias("origin"), "data").join(asked, ["key_a", "key_b", "origin"])
        finer = written(again.mapInPandas(cut, STRING))
        ready = ready.unionByName(finer.where(~hot) if minima else finer)
        hotter = finer.where(hot)
    return ready, whole


def remove(docs: DataFrame, length: int = 400, keep_text: bool = False, by_word: bool = False, **options) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256, and with text as the bytes kept if asked for, else without text.

    A byte goes if a string of `length` bytes over it also starts elsewhere in the input, the same document included.
    A null text is empty, texts shorter than length keep all. Repeated rows are documents of their own, so equal long texts
    go as a whole. Kept bytes that are no valid UTF-8 by themselves (a character was cut) are hashed as they are; in a kept
    text they become U+FFFD. With by_word, length is a number of words: what goes are runs of words that occur again, from their first
    word to their last, whatever white space is between them (words are compared by 48 bits of hash). Other columns stay; those named like a result are replaced. An empty table gives no rows.
    """
    prepare(docs.sparkSession, 256)
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    held = docs.drop(*results)
    ka, kb, ranges, cut, sha, gone, parts, least = fresh(held, "key_a", "key_b", "ranges", "cut", "sha", "gone", "parts", "least")
    found = written(repeats(docs, length, by_word=by_word, **options)).withColumnsRenamed({"key_a": ka, "key_b": kb, "ranges": ranges})
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = held.withColumns({ka: F.xxhash64(whole), kb: F.xxhash64(F.lit(1), whole)})

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text)
    def kept(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(text, ranges):
            data, parts, at, gone = t.encode("utf-8", "surrogatepass"), [], 0, 0
            merged = _merged([(int(x["lo"]), int(x["hi"])) for x in r]) if r is not None else []
            if merged and by_word:
                start, stop, _ = words(np.frombuffer(data, dtype=np.uint8))
                merged = [(int(start[-(-lo // WIDE)]), int(stop[hi // WIDE - 1])) for lo, hi in merged]
            for lo, hi in merged:
                parts.append(data[at:lo])
                at, gone = hi, gone + hi - lo
            parts.append(data[at:])
            left = b"".join(parts)
            out.append((gone, len(merged), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace") if gone else None] if keep_text else [])))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    kept = kept.asNondeterministic()  # else a filter on its result works it out once more

    others = [c for c in held.columns if c != "text"]
    own = lambda *x: [*others, F.octet_length(whole).cast("long").alias("n_bytes"), *x]
    some, none = parted(keyed, ka, found)  # texts that lose nothing are not shuffled
    if keep_text:
        done = some.join(found, [ka, kb], "left").withColumn(cut, kept(whole, ranges))
        left = F.when(F.col(cut)["n_removed"] > 0, F.col(cut)["kept"]).otherwise(F.col("text").cast("string")).alias("text")
        zero = F.lit(0).cast("long")
        rest = none.select(*own(zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), F.col("text").cast("string").alias("text")))
        return done.select(*own(f"{cut}.n_removed", f"{cut}.n_spans", f"{cut}.kept_sha256", left)).unionByName(rest)
    # only the texts that lose something are cut; the others are hashed where they are read
    # of equal texts, that of the least document; its id is part of what is joined by, so that the others don't meet in one task
    first = some.groupBy(ka, kb).agg(F.min(F.col("doc_id").cast("string")).alias(least))
    place = F.col("doc_id").cast("string").alias(least)
    asked = found.join(first, [ka, kb]).withColumn(least, F.coalesce(least, F.lit("")))
    cut_texts = some.select(ka, kb, F.coalesce(place, F.lit("")).alias(least), "text").join(asked, [ka, kb, least]).withColumn(cut, kept("text", ranges))
    changed = cut_texts.groupBy(ka, kb).agg(F.max(f"{cut}.n_removed").alias(gone), F.max(f"{cut}.n_spans").alias(parts), F.max(f"{cut}.kept_sha256").alias(sha))
    row = keyed.select(*own(ka, kb, F.sha2(whole, 256).alias("kept_sha256"))).join(changed, [ka, kb], "left")
    count = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return row.select(*others, "n_bytes", count(gone, "n_removed"), count(parts, "n_spans"), F.coalesce(sha, "kept_sha256").alias("kept_sha256"))
