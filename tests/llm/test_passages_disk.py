"""Texts without a repeated passage are not moved when passages are looked for, and bitmaps of keys miss no key."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from quillstone.llm import suffixdedup
from quillstone.llm.common import parted

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shuffled(spark, run) -> int:
    """Bytes that the stages of run() write into shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        held = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(held.apply(i).shuffleWriteBytes() for i in range(held.size()))

    before = total()
    run()
    return total() - before


def texts(rng, n, words, shared):
    """n texts of words of their own; every tenth has the shared passage in it as well."""
    word = lambda k: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(k))
    passage = word(shared)
    return [word(words) + (f" {passage} " + word(5) if i % 10 == 0 else "") for i in range(n)]


def test_texts_without_repeats_stay_where_they_are(spark):
    data = texts(random.Random(5), 400, 900, 60)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(data)], DOC)
    size = sum(map(len, data))
    left = {}
    moved = shuffled(spark, lambda: left.update({r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}))
    assert moved < 0.7 * size
    for i, t in enumerate(data):
        words = t.split(" ")
        want = t if i % 10 else " ".join(words[:900]) + "  " + " ".join(words[-5:])
        assert left[i] == (want, len(want))
    assert shuffled(spark, lambda: suffixdedup.remove(docs).collect()) < 0.7 * size


def test_parted_misses_no_key(spark):
    frame = spark.range(20_000).select("id", F.when(F.col("id") % 11 != 0, F.xxhash64("id")).alias("k"), F.lit(1).alias("_may"), F.lit(2).alias("_bits"))
    for n, most in ((0, 4), (1, 4), (3000, 4), (3000, 1), (20_000, 4096)):
        keys = frame.where(F.col("id") < n).select("k")
        some, none = parted(frame, "k", keys, most)
        assert some.columns == none.columns == frame.columns
        held, rest = ({r["id"] for r in x.select("id").collect()} for x in (some, none))
        assert not held & rest and len(held) + len(rest) == 20_000
        sure = {i for i in range(n) if i % 11}
        assert sure <= held and (most < 4 or len(held) <= 1.1 * len(sure) + 0.05 * 20_000)
