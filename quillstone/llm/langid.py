"""Language identification with string kernels.

Texts are compared by a blended-spectrum presence kernel: the cosine of their sets of byte
1-, 2- and 3-grams. Nystroem landmarks turn it into features, on which one-versus-rest kernel ridge regression
is fitted; texts are scored by batched matrix products with the landmarks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, prepare
from quillstone.llm.grams import packed, presence_by_segment, unpacked

#: A letter; numerals such as those in circles or Roman ones are none.
LETTER = regex.compile(r"\p{L}")
DIMS = 1 << 13
#: Bytes of a segment: presence of n-grams tells little of long texts, which hold them all.
WIDTH = 768
#: Segments of a text that are learnt from, at most, spread over it.
LEARNT = 4


@dataclass
class Model:
    labels: list[str]
    landmarks: np.ndarray  # a unit row of n-gram presence each
    weights: np.ndarray  # of landmark similarities, a column per label
    dims: int = DIMS
    width: int = WIDTH

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean score of each text's segments, weighted by their bytes: a short passage in another language moves it little.

        Similarities to landmarks times weights are one product with landmarks' transpose times weights.
        """
        primal = self.landmarks.T @ self.weights
        parts = [presence_by_segment(t, self.dims, self.width) for t in texts]
        x = np.concatenate([bits for bits, _ in parts])
        size = np.concatenate([n for _, n in parts]).astype(np.float32)
        s = np.concatenate([x[k : k + 512].astype(np.float32) @ primal for k in range(0, len(x), 512)])
        s *= (size / np.sqrt(np.maximum(x.sum(1), 1)))[:, None]
        first = np.cumsum([0, *[len(n) for _, n in parts]])[:-1]
        return np.add.reduceat(s, first, axis=0) / np.add.reduceat(size, first)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, sure = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        batches: list[list[int]] = []
        held = 0
        for i in at if self.labels else []:  # bounded by bytes, as texts may be long
            if not batches or held > 256 * self.width:
                batches.append([])
                held = 0
            batches[-1].append(i)
            held += len(texts[i])
        for rows in batches:
            s = self.scores([texts[i] for i in rows])
            best = s.argmax(1)
            p = np.exp(8.0 * (s - s.max(1, keepdims=True)))
            p = p.max(1) / p.sum(1)
            for i, b, q in zip(rows, best, p):
                labels[i], sure[i] = self.labels[b], float(min(1.0, max(0.0, q)))
        return labels, sure


def train(labelled: DataFrame, per_label: int = 300, landmarks_per_label: int = 40, ridge: float = 1e-2, dims: int = DIMS) -> Model:
    """Fit on at most per_label distinct texts of each lang, chosen by hash of the text, and four segments of each.

    The bound is on labelled rows: n-gram bits (dims / 8 bytes a segment) are what reaches the driver. Rows of a null lang, a null text
    or one without letters are passed over; if none is left, the model knows no language and answers und.
    """
    prepare(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    # only hashes are ranked; the highest hash of each lang then picks the texts where they are read
    hashed = known.withColumn("_h", F.xxhash64("text"))
    # ranked in parts first, so that what meets for a lang does not grow with the rows
    part = Window.partitionBy("lang", F.pmod("_h", F.lit(8))).orderBy("_h")
    top = Window.partitionBy("lang").orderBy("_h")
    ranked = hashed.select("lang", "_h").distinct()
    for window in (part, top):
        ranked = ranked.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= per_label).select("lang", "_h")
    highest = {r["lang"]: r["_m"] for r in ranked.groupBy("lang").agg(F.max("_h").alias("_m")).collect()}
    if not highest:
        return Model([], np.zeros((0, dims), np.float32), np.zeros((0, 0), np.float32), dims)
    limit = F.create_map(*[F.lit(x) for pair in highest.items() for x in pair])
    sample = hashed.where(F.col("_h") <= F.try_element_at(limit, F.col("lang"))).groupBy("lang", "_h").agg(F.min("text").alias("text"))

    def bits(batches):
        for pdf in batches:
            out = []
            for lang, t in zip(pdf["lang"], pdf["text"]):
                x, _ = presence_by_segment(t, dims, WIDTH)
                out += [(lang, packed(x[i])) for i in sorted({round(i) for i in np.linspace(0, len(x) - 1, min(LEARNT, len(x)))})]
            yield pd.DataFrame(out, columns=["lang", "bits"])

    rows = sorted((r["lang"], bytes(r["bits"])) for r in sample.mapInPandas(bits, "lang string, bits binary").collect())
    labels = sorted({lang for lang, _ in rows})
    x = unpacked([b for _, b in rows])
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([[1.0 if lang == k else -1.0 for k in labels] for lang, _ in rows])
    groups = {k: [i for i, (lang, _) in enumerate(rows) if lang == k] for k in labels}
    chosen = [i for k in labels for i in groups[k][:: max(1, len(groups[k]) // landmarks_per_label)][:landmarks_per_label]]
    marks = x[chosen]
    among = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # whitened landmark similarities
    z = (x @ marks.T).astype(np.float64) @ root
    share = np.array([len(groups[lang]) for lang, _ in rows], dtype=float)
    weight = (len(rows) / len(labels) / share)[:, None]  # languages count alike
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * len(rows) / 100 * np.eye(z.shape[1]), z.T @ (weight * y))
    return Model(labels, marks.astype(np.float32), (root @ solved).astype(np.float32), dims)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; und and 0 where the text is null or has no letter.

    Every row is judged by its whole text alone; rows, repeated ones too, and all other columns stay. Columns named
    lang_pred or score are replaced. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    held = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: landmarks x n-gram bits

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        labels, sure = shared.value.predict(list(texts))
        return pd.DataFrame({"lang_pred": labels, "score": sure})

    (found,) = fresh(held, "found")
    return held.withColumn(found, judged("text")).select(*held.columns, F.col(found)["lang_pred"].alias("lang_pred"), F.col(found)["score"].alias("score"))


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4 is 2; false for a null doc_id, which is never learnt from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
