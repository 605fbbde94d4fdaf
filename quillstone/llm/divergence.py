"""How far each source's words are from those of the other sources of its language, in exact arithmetic.

Texts are cut by a lookup table of bytes over concatenated UTF-8 buffers; xxhash groups the slices and equal hashes are verified byte by byte.
Counts go to blocks of terms, in which each source is a row of a CSR matrix; divergences are sums over row boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import prepare, written

SCALE = 10**9
#: Bytes of terms: ASCII letters and all of other characters.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def grouped(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed=None) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): xxhash groups them, and each slice is compared with its group's first byte by byte.

    Slices that differ from their group's first (a collision) are told apart by their bytes.
    """
    import xxhash

    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw, hash_of = data.tobytes(), hashed or xxhash.xxh3_64_intdigest
    hashes = np.fromiter((hash_of(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = end - start, first[group]
    odd = size != size[like]
    for at in range(0, len(start), 1 << 18):  # compared in parts, to bound the copies
        same = at + np.flatnonzero(~odd[at : at + (1 << 18)])
        s = size[same]
        differs = gathered(data, start[same], s) != gathered(data, start[like[same]], s)
        if differs.any():
            odd[same] = np.add.reduceat(differs, np.cumsum(s) - s) > 0
    if odd.any():
        known: dict[tuple[int, bytes], int] = {}
        firsts = list(first)
        for i in np.flatnonzero(odd):
            at = known.setdefault((int(hashes[i]), raw[start[i] : end[i]]), len(firsts))
            if at == len(firsts):
                firsts.append(i)
            group[i] = at
        first = np.array(firsts)
    return group, first


def counted(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """lang, source, term, n, docs of some documents: a term's occurrences and the documents that have it."""
    text, keys = text.cast(pa.large_string()), pa.table({"lang": lang, "source": source})
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = IN_TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    seams = offsets[(offsets > 0) & (offsets < len(data))]  # no slice crosses documents
    begins[seams], ends[seams - 1] = inside[seams], inside[seams - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    data = LOWER[data]
    group, first = grouped(data, start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    names = keys.group_by(["lang", "source"], use_threads=False).aggregate([]).combine_chunks()
    where = {p: i for i, p in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist()))}
    owner = np.array([where[p] for p in zip(lang.to_pylist(), source.to_pylist())], dtype=np.int64)
    terms = max(1, len(first))
    in_doc, times = np.unique(doc * terms + group, return_counts=True)
    cells, at = np.unique(owner[in_doc // terms] * terms + in_doc % terms, return_inverse=True)
    raw, of = data.tobytes(), pa.array(cells // terms)
    words = pa.array([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], pa.binary()).cast(pa.string())
    return pa.table({
        "lang": names["lang"].take(of), "source": names["source"].take(of), "term": words.take(pa.array(cells % terms)),
        "n": np.bincount(at, weights=times, minlength=len(cells)).astype(np.int64), "docs": np.bincount(at, minlength=len(cells)),
    })


def term_counts(docs: DataFrame, bytes_at_once: int = 4 << 20, rows_at_once: int = 1 << 20) -> DataFrame:
    """lang, source, term, n, docs: counts of a task's documents, in parts: a term of a group has a row for each rows_at_once rows of the task.

    docs: lang, source, text, without nulls. A task holds the texts of bytes_at_once bytes, or one longer text, and rows_at_once counts.
    """
    columns = ["lang", "source", "term", "n", "docs"]

    def merged(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by(columns[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(columns)

    def run(batches):
        held: list[pa.RecordBatch] = []
        tables: list[pa.Table] = []
        size = rows = 0

        def flush() -> int:
            if held:
                tables.append(counted(*(pa.concat_arrays([b.column(k) for b in held]) for k in (2, 0, 1))))
                held.clear()
                return len(tables[-1])
            return 0

        for b in batches:
            if len(b):
                held.append(b)
                size += b.column(2).nbytes
            if size >= bytes_at_once:
                rows, size = rows + flush(), 0
            if rows >= rows_at_once:
                tables[:] = [merged(tables)]
                rows = len(tables[0])
                if 2 * rows >= rows_at_once:  # few of them met again
                    yield from tables.pop().to_batches(max_chunksize=1 << 14)
                    rows = 0
        flush()
        if tables:
            yield from merged(tables).to_batches(max_chunksize=1 << 14)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def scaled(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * n / total), exact for n <= total < 2^53: a long division in three digits of base 1000."""
    q, r = np.zeros_like(n), n
    for _ in range(3):
        q, r = q * 1000 + (r * 1000) // total, (r * 1000) % total
    return q + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are 10^9 + 1 at most, so the square is a long."""
    d = p - q
    return d * d // q


def block_values(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """source, part, item, value: sums of each ordered pair of a language's sources over a block of terms, and the block's top terms of each source.

    counts: source, term, n, lang_n. groups: source, total (its words among kept terms), lang_total, terms (kept ones of all blocks). A sum takes
    every other source as if it had no term of the block, and then puts that one's own entries right.
    """
    names = sorted(groups["source"].to_pylist())
    place = {name: i for i, name in enumerate(names)}
    total = np.zeros(len(names), np.int64)
    total[[place[x] for x in groups["source"].to_pylist()]] = groups["total"].to_numpy()
    kept, s = groups["terms"][0].as_py(), len(names)
    term, source = (counts[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
    rows = np.array([place[x] for x in source.dictionary.to_pylist()], dtype=np.int64)[source.indices.to_numpy()] if len(counts) else np.zeros(0, np.int64)
    order = np.lexsort((term.indices.to_numpy(), rows))
    rows, cols, n, lang_n = rows[order], term.indices.to_numpy().astype(np.int64)[order], counts["n"].to_numpy()[order], counts["lang_n"].to_numpy()[order]
    width = len(term.dictionary)
    indptr = np.searchsorted(rows, np.arange(s + 1))
    filled = np.flatnonzero(np.diff(indptr))
    total += kept
    base = scaled(np.ones(s, np.int64), total) if kept else np.ones(s, np.int64)
    p = scaled(n + 1, total[rows]) if len(n) else n
    sums = np.zeros((s, s), np.int64)
    for a in range(s):
        lo, hi = indptr[a], indptr[a + 1]
        dense = np.full(width, base[a])
        dense[cols[lo:hi]] = p[lo:hi]
        sums[a] = (width - (hi - lo)) * apart(base[a], base)
        if hi > lo:
            sums[a] += np.array([apart(p[lo:hi], q).sum() for q in base], dtype=np.int64)
        if len(filled):
            here = dense[cols]
            sums[a, filled] += np.add.reduceat(apart(here, p) - apart(here, base[rows]), indptr[filled])
    off = ~np.eye(s, dtype=bool)
    mine, other = np.nonzero(off)
    named = pa.array(names, pa.string())
    parts = [pa.table({"source": named.take(pa.array(mine)), "part": pa.array(["pair"] * len(mine), pa.string()), "item": named.take(pa.array(other)), "value": sums[off]})]
    if len(n):
        q = scaled(lang_n + 1, np.full(len(n), groups["lang_total"][0].as_py() + kept))
        over = np.flatnonzero(p > q)
        value = apart(p[over], q[over])
        words = term.dictionary.take(pa.array(cols[over]))
        by_bytes = np.empty(len(over), np.int64)
        by_bytes[np.asarray(pa.compute.sort_indices(words.cast(pa.binary())))] = np.arange(len(over))
        best = np.lexsort((by_bytes, -value, rows[over]))
        first = np.searchsorted(rows[over][best], rows[over][best])
        best = best[np.arange(len(best)) - first < top]
        parts.append(pa.table({"source": named.take(pa.array(rows[over][best])), "part": pa.array(["term"] * len(best), pa.string()), "item": words.take(pa.array(best)), "value": value[best]}))
    return pa.concat_tables(parts)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, rows_per_block: int = 200_000, bytes_at_once: int = 4 << 20) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of each (lang, source) from the other sources of its lang, and its own typical terms.

    A null text, lang or source is ''. Repeated rows are documents of their own. A text without terms still gives its group, and a lang without
    kept terms gives its pairs with value 0. Ties of the value go to the smaller item by UTF-8 bytes. A lang of one source has no pairs. Other
    columns are left out, whatever their names; an empty table gives no rows. Counts are exact below 2^53 words a group.

    Counts are shuffled once, by lang and term, to tell the kept terms and to sum what is kept; only that is written. Each block holds
    about rows_per_block of a lang's counts, so neither a hot lang nor a hot source meets in one task.
    """
    spark = docs.sparkSession
    prepare(spark)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(named, bytes_at_once).repartition("lang", "term")
    # both uses read all columns of the counts, so the same shuffle serves both
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("df"), F.count("source").alias("rows"))
    kept = kept.where((F.col("df") >= least_docs) & (F.col("rows") > 0)).select("lang", "term", "lang_n")
    summed = counts.join(kept.hint("shuffle_hash"), ["lang", "term"]).groupBy("lang", "source", "term", "lang_n").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = written(summed)
    # a row for each lang, and one for each group: small beside the counts
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c, least=0: F.coalesce(F.col(c), F.lit(least)).alias(c)
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(terms, "lang", "left")
    groups = written(groups.select("lang", "source", zero("total"), zero("lang_total"), zero("terms"), zero("blocks", 1)))
    ranges = groups.select("lang", F.col("blocks").alias("of")).distinct()
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(1 << 30)))
    if ranges.count() <= 100_000:  # a row a lang
        dealt = dealt.join(F.broadcast(ranges), "lang")
    else:  # each lang over salts
        salts = 64
        salted = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = dealt.withColumn("salt", (F.col("deal") % salts).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    dealt = dealt.withColumn("block", (F.col("deal") % F.col("of")).cast("int")).drop("deal", "of")
    everywhere = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def values(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
        out = block_values(counts, groups, top)
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * len(out), pa.string()))

    partial = dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(values, "lang string, source string, part string, item string, value long")
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    own = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")  # a row a source, and `top` a block
    ranked = summed.withColumn("rank", F.row_number().over(own))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
