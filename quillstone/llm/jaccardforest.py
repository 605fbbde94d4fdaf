"""Joining documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

Equal sets collapse first. A MinHash LSH forest holds the others: in each tree a set's signature, minima of the tree's own hash
functions, is a word of a prefix trie. A node is the sets below one prefix. Every set goes up from its longest prefix while
the node above holds few enough sets, at the most to the prefix at which a pair at the threshold is found with the recall asked for;
a node that is too full is not gone up to, down to the prefix that still finds a pair at the threshold with the least recall allowed.
Nodes of the same members in several trees are one. Sets are compared exactly within nodes, each pair in that of the
first tree that matches it, and links are counted, not listed.

A node that holds very many sets even so is dealt into blocks, and pairs of blocks go to different tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, partitions, prepare, release, shared_dir
from quillstone.llm.components import components

_RNG = np.random.default_rng(977)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = 0xD6E8FEB86659FD93
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_B, -1, 1 << 64)
            for name, base in (("up", _B), ("down", inverse)):
                p = np.ones(size, np.uint64)
                p[1:] = np.uint64(base)
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash) of each word."""
    edge = np.diff(np.concatenate(([True], _BLANK[raw], [True])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = Powers.to(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])))
    return start, stop, _mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def shingles(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; all words as one run if there are fewer; none of no words."""
    _, _, word = words(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
    if not len(word):
        return np.zeros(0, np.uint64)
    k = min(k, len(word))
    run = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        run = run * np.uint64(0x9FB21C651E98DF25) + word[i : len(word) - k + 1 + i]
    return np.unique(_mix(run + np.uint64(k)))


def depth_for(threshold: float, trees: int, recall: float, most: int) -> int:
    """The longest prefix at which some tree matches a pair at the threshold with the recall asked for."""
    for depth in range(most, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def tries(sets: np.ndarray, trees: int, least: int, most: int) -> list[int]:
    """Of one tree after the other, the set's nodes from the prefix of `least` minima to that of `most`, named by hashes of tree and prefix."""
    rng = np.random.default_rng(4242)
    a = rng.integers(0, 1 << 63, trees * most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, trees * most, dtype=np.uint64)
    low = np.empty(trees * most, np.uint64)
    step = max(1, (1 << 15) // len(sets))  # functions at a time
    for j in range(0, trees * most, step):
        y = sets[None, :] * a[j : j + step, None] + b[j : j + step, None]
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        low[j : j + step] = y.min(1)
    raw = low.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[8 * t * most : 8 * (t * most + d)], seed=t) - (1 << 63) for t in range(trees) for d in range(least, most + 1)]


def compare(sets: list[np.ndarray], keys: np.ndarray, mask: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j), i of left and j of right, i < j as positions, that this group has to count.

    keys: of each set its prefixes, a column per tree; mask: the trees in which the members form this group.
    A pair belongs to the group of the first tree that it matches in.
    """
    sizes = np.array([len(s) for s in sets])
    first = np.full((len(left), len(right)), -1, np.int8)
    for t in range(keys.shape[1] - 1, -1, -1):
        first[keys[left, t][:, None] == keys[right, t][None, :]] = t
    own = np.array([bool(mask >> t & 1) for t in range(keys.shape[1])])
    due = (first >= 0) & own[first] & (left[:, None] < right[None, :])
    a, b = sizes[left][:, None], sizes[right][None, :]
    due &= np.minimum(a, b) >= threshold * np.maximum(a, b)
    i, j = np.nonzero(due)
    if not len(i):
        return i, j
    if len(i) <= 64 or len(i) * 8 < len(left):
        both = np.array([len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True)) for x, y in zip(i, j)])
    else:
        every = np.concatenate([sets[x] for x in np.union1d(left, right)])
        values, counts = np.unique(every, return_counts=True)
        values = values[counts >= 2]
        rows = np.union1d(left, right)
        place = {int(x): k for k, x in enumerate(rows)}
        total = np.zeros((len(left), len(right)), np.float32)
        il, ir = [place[int(x)] for x in left], [place[int(x)] for x in right]
        for at in range(0, len(values), 8192):
            part = values[at : at + 8192]
            held = np.zeros((len(rows), len(part)), np.float32)
            for k, x in enumerate(rows):
                s = sets[x]
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                p = np.searchsorted(part, s)
                held[k, p[part[p] == s]] = 1
            total += held[il] @ held[ir].T
        both = total[i, j].astype(np.int64)
    union = sizes[left[i]] + sizes[right[j]] - both
    linked = both >= threshold * union - 1e-9
    return left[i[linked]], right[j[linked]]


def join(docs: DataFrame, threshold: float = 0.8, k: int = 5, trees: int = 20, depth: int = 6, recall: float = 0.999999, least_recall: float = 0.9999,
         full: int = 128, block: int = 512, volume: int = 1 << 22, one_each: bool = False) -> DataFrame:
    """docs with n_shingles, class_id and n_links; with one_each, docs themselves, of each class one row.

    n_links is the number of other rows whose set has a Jaccard similarity of threshold or more with the row's own, copies
    counted; class_id is the least doc_id of the rows linked with it, directly or in turn. A text of fewer than k words has
    all its words as one shingle. Null texts and texts without words have no shingles, no links, and are classes of their own; so are
    rows of null doc_id that link to nothing (class_id null). Repeated rows are copies. Other columns stay; those named like a result are
    replaced. An empty table gives no rows.

    A pair at the threshold is found with `recall`, or `least_recall` if its nodes in all trees hold more than `full` sets; a more
    similar pair is found more surely. The row that stays of a class is that of the least doc_id, nulls last; among rows of one doc_id,
    that of the least hash. A class is one of linked sets here, whatever ids its rows have. Rows without shingles all stay.

    Nodes of more than `block` sets, or of more than `volume` shingles in all, are dealt into blocks, so what meets in a task is bounded for long texts too.
    """
    spark = docs.sparkSession
    prepare(spark, 256)
    shared_dir(spark)
    n = partitions(spark)
    low = depth_for(threshold, trees, recall, depth)
    high = max(low, min(depth_for(threshold, trees, least_recall, depth), low + 3))
    held = docs.drop("n_shingles", "class_id", "n_links")
    key = [F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b")]

    def emit(batches):
        for pdf in batches:
            out = []
            for a, b, text in zip(pdf["key_a"], pdf["key_b"], pdf["text"]):
                s = shingles(text, k)
                if len(s):
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    out.append((a, b, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), len(s), tries(s, trees, low, high)))
            yield pd.DataFrame(out, columns=["key_a", "key_b", "set_a", "set_b", "n_shingles", "paths"])

    texts = held.where("text IS NOT NULL").select(*key, "text")
    signed = texts.mapInPandas(emit, "key_a long, key_b long, set_a long, set_b long, n_shingles long, paths array<long>").checkpoint()
    # a text's key stands for it: equal texts give equal rows here
    of_text = signed.groupBy("key_a", "key_b").agg(F.min("set_a").alias("set_a"), F.min("set_b").alias("set_b"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("rows"))
    ids = held.select(*key, "doc_id").where("text IS NOT NULL").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("least"))
    sets = of_text.join(ids, ["key_a", "key_b"]).groupBy("set_a", "set_b").agg(
        F.sum("rows").alias("rows"), F.min("least").alias("least"), F.min(F.struct("key_a", "key_b", "least")).alias("stands")).checkpoint()

    one = signed.groupBy("set_a", "set_b").agg(F.first("paths").alias("paths"), F.first("n_shingles").alias("n_shingles"))  # equal sets have equal prefixes
    levels = high - low + 1
    starts = [F.struct(F.lit(t).alias("tree"), F.slice("paths", t * levels + 1, levels).alias("path")) for t in range(trees)]
    live = one.select("set_a", "set_b", "n_shingles", F.explode(F.array(*starts)).alias("at")).select("set_a", "set_b", "n_shingles", "at.tree", "at.path", F.col("at.path")[0].alias("key"))
    nodes, deeper = [], []
    for level in range(levels):
        # a key names its tree too; few sets share a node with others, and only they go on
        shared = live.join(live.groupBy("key").agg(F.count("*").alias("g")).where("g >= 2"), "key").checkpoint()
        too_full = F.col("g") > full
        if level == levels - 1 or shared.where(too_full).isEmpty():
            nodes.append(shared)
            break
        nodes.append(shared.where(~too_full))
        # the sets of nodes that are too full stay below, on a longer prefix
        live = shared.where(too_full).select("set_a", "set_b", "n_shingles", "tree", "path", F.col("path")[level + 1].alias("key"))
        deeper.append(live.select("set_a", "set_b", F.expr("shiftleft(1L, 2 * tree)").alias("deep")))
    placed = reduce(DataFrame.unionByName, nodes).select("set_a", "set_b", "n_shingles", "tree", "key", "g")
    groups = placed.groupBy("tree", "key").agg(F.first("g").alias("g"), F.sum("n_shingles").alias("v"), F.bit_xor("set_a").alias("x"), F.bit_xor("set_b").alias("y"))
    same = groups.groupBy("g", "x", "y").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("mask"), F.min(F.struct("tree", "key")).alias("at"), F.max("v").alias("v"))
    members = placed.drop("n_shingles").join(same.select("at.tree", "at.key", "mask", "v"), ["tree", "key"]).join(sets.select("set_a", "set_b", "rows", "stands.*"), ["set_a", "set_b"])
    # two bits a tree: how many minima longer than the shortest prefix the set's node is
    if deeper:
        depths = reduce(DataFrame.unionByName, deeper).groupBy("set_a", "set_b").agg(F.sum("deep").alias("deep"))
        members = members.join(depths, ["set_a", "set_b"], "left")
    else:
        members = members.withColumn("deep", F.lit(0).cast("long"))
    # blocks of a large group: every pair of blocks is a task, so a set goes to as many as there are blocks
    blocks = F.greatest(F.lit(1), F.ceil(F.col("g") / block), F.ceil(F.col("v") / volume)).cast("int")
    own = F.pmod(F.xxhash64("set_a", "set_b"), F.col("_m")).cast("int")
    wanted = members.withColumn("_m", blocks).withColumn("_o", own).groupBy("key_a", "key_b", "least", F.coalesce("deep", F.lit(0)).cast("long").alias("deep")).agg(
        F.collect_list(F.struct("tree", "key", "mask", "rows", "_m", "_o")).alias("nodes"))
    # of equal texts, the one of the least doc_id is sent
    named = held.where("text IS NOT NULL").select(*key, "doc_id", "text")
    first_text = named.join(wanted, (named["key_a"] == wanted["key_a"]) & (named["key_b"] == wanted["key_b"]) & named["doc_id"].eqNullSafe(wanted["least"])).select("text", "deep", "nodes")

    def send(batches):
        columns = ["tree", "key", "lo", "hi", "own", "mask", "set_a", "set_b", "rows", "prefixes", "data"]
        for pdf in batches:
            out, size = [], 0
            for text, deep, at in zip(pdf["text"], pdf["deep"], pdf["nodes"]):
                s = shingles(text, k)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                sa, sb, raw = (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), s.tobytes()
                path = tries(s, trees, low, high)
                prefixes = [path[t * levels + (deep >> 2 * t & 3)] for t in range(trees)]
                for r in at:
                    m, o = int(r["_m"]), int(r["_o"])
                    for other in range(m):
                        lo, hi = min(o, other), max(o, other)
                        out.append((r["tree"], r["key"], lo, hi, o, r["mask"], sa, sb, r["rows"], prefixes, raw))
                        size += len(raw)
                        if size > 1 << 24:  # a long set of many nodes and blocks leaves in parts
                            yield pd.DataFrame(out, columns=columns)
                            out, size = [], 0
            yield pd.DataFrame(out, columns=columns)

    sent_type = "tree int, key long, lo int, hi int, own int, mask long, set_a long, set_b long, rows long, prefixes array<long>, data binary"
    sent = first_text.mapInPandas(send, sent_type).repartition(n, "tree", "key", "lo", "hi").sortWithinPartitions("tree", "key", "lo", "hi", "set_a", "set_b")

    def verify(batches):
        now, rows = None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at = tuple(row[:4])
                if at != now:
                    if len(rows) > 1:
                        yield links(rows)
                    now, rows = at, []
                if not rows or (rows[-1].set_a, rows[-1].set_b) != (row.set_a, row.set_b):  # equal texts send the same
                    rows.append(row)
        if len(rows) > 1:
            yield links(rows)
        release()

    def links(rows: list) -> pd.DataFrame:
        sets_ = [np.frombuffer(r.data, dtype=np.uint64) for r in rows]
        keys = np.array([r.prefixes for r in rows], dtype=np.int64)
        owner = np.array([r.own for r in rows])
        lo, hi = rows[0].lo, rows[0].hi
        left = np.flatnonzero(owner == lo)
        right = np.flatnonzero(owner == hi)
        if lo == hi:
            i, j = compare(sets_, keys, int(rows[0].mask), left, right, threshold)
        else:  # each pair of the two blocks once, whichever comes first
            i, j = compare(sets_, keys, int(rows[0].mask), left, right, threshold)
            p, q = compare(sets_, keys, int(rows[0].mask), right, left, threshold)
            i, j = np.concatenate((i, p)), np.concatenate((j, q))
        weight = np.array([r.rows for r in rows], dtype=np.int64)
        count = np.zeros(len(rows), np.int64)
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
        parent = list(range(len(rows)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            parent[root(x)] = root(y)
        at = np.flatnonzero(count)
        tops = [rows[root(x)] for x in at.tolist()]
        return pd.DataFrame({
            "set_a": [rows[x].set_a for x in at], "set_b": [rows[x].set_b for x in at], "links": count[at],
            "top_a": [t.set_a for t in tops], "top_b": [t.set_b for t in tops]}).astype("int64")

    found = sent.mapInPandas(verify, "set_a long, set_b long, links long, top_a long, top_b long").checkpoint()
    counts = found.groupBy("set_a", "set_b").agg(F.sum("links").alias("links"))
    # 128-bit names of sets, as one comparable value
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    roots = components(found.select(name("set_a", "set_b").alias("a"), name("top_a", "top_b").alias("b")))
    placed = sets.withColumn("node", name("set_a", "set_b")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if one_each:
        return _one_of_each(docs, of_text, placed.select("set_a", "set_b", "root"))
    least = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    by_set = placed.join(least, "root").join(counts, ["set_a", "set_b"], "left").select("set_a", "set_b", "class_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    by_text = of_text.join(by_set, ["set_a", "set_b"]).select("key_a", "key_b", "n_shingles", "class_id", "n_links")
    ka, kb = fresh(held, "key_a", "key_b")
    keyed = held.withColumns({ka: F.xxhash64("text"), kb: F.xxhash64(F.lit(1), "text")})
    return keyed.join(by_text.withColumnsRenamed({"key_a": ka, "key_b": kb}), [ka, kb], "left").select(
        *held.columns, F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").cast("long").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _one_of_each(docs: DataFrame, of_text: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of each class; of_text has the set of each text, roots the class of each set.

    Rows are told apart by hashes, and only those that repeat as a whole are compared with their text.
    """
    every = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    a, b, r, s, root, copies, worded, x, y, n = fresh(docs, "a", "b", "r", "s", "root", "copies", "worded", "x", "y", "n")
    keyed = docs.withColumns({a: F.xxhash64("text"), b: F.xxhash64(F.lit(1), "text"), r: F.xxhash64(*every), s: F.xxhash64(F.lit(1), *every)})
    rows = keyed.where("text IS NOT NULL").groupBy(a, b, "doc_id", r, s).agg(F.count("*").alias(copies))
    texts = of_text.join(roots, ["set_a", "set_b"]).select(F.col("key_a").alias(a), F.col("key_b").alias(b), F.col("root").alias(root))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", r, s, a, b, copies)
    least = rows.join(texts, [a, b]).groupBy(root).agg(F.min(order).alias("m"))
    chosen = least.select(F.col("m")[a].alias(a), F.col("m")[b].alias(b), F.col("m")[r].alias(x), F.col("m")[s].alias(y), F.col("m")[copies].alias(n)).checkpoint()
    own = (F.col(r) == F.col(x)) & (F.col(s) == F.col(y))
    known = texts.drop(root).join(chosen, [a, b], "left").withColumn(worded, F.lit(True))
    stay = keyed.join(known, [a, b], "left").where(F.col(worded).isNull() | own & (F.col(n) == 1)).select(*docs.columns)
    again = keyed.join(chosen.where(F.col(n) > 1), [a, b]).where(own).dropDuplicates([a, b]).select(*docs.columns)
    return stay.unionByName(again)
