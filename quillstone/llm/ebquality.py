"""Quality of documents from their own evidence and that of their site.

A document classifier (logistic regression on n-gram presence and style) gives each document a probability. Sites and
paths below them get posteriors from all their documents, by empirical Bayes in two levels: a path shrinks toward its
site and a site toward all, the more so the fewer documents it has. The prior of the path then moves the document's own odds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, prepare, written
from quillstone.llm.grams import packed, presence

DIMS = 1 << 11
SALTS = 32
_SYMBOL = re.compile(r"[#*$%&|<>!_=~^\\/{}\[\]]")


def style(text: str) -> list[float]:
    """Shares that tell prose from junk: symbols, capitals, digits, letters, line and word repetition, and word length."""
    n = max(len(text), 1)
    ws = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, ws)) / max(len(ws), 1)
    return [
        len(_SYMBOL.findall(text)) / n * 10, upper, sum(map(str.isdigit, ws)) / max(len(ws), 1) * 5, 1 - len(set(ws)) / max(len(ws), 1),
        1 - len(set(lines)) / max(len(lines), 1), min(n / max(len(ws), 1), 20) / 10, min(np.log1p(len(ws)) / 10, 1.0), float(len(ws) < 10),
    ]


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def probability(self, texts: list[str]) -> np.ndarray:
        x = np.stack([np.concatenate((presence(t, DIMS).astype(np.float32) / 32, style(t))) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000, steps: int = 400) -> Classifier:
    """Fit on at most `most` labelled documents, chosen by hash of doc_id; their whole texts are read.

    What reaches the driver is a fixed number of bytes a labelled document. Of a doc_id labelled twice, the least label counts; of
    one that several rows have, the least text. Nothing labelled gives a classifier that answers one half.
    """
    prepare(docs.sparkSession, 256)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["_y"].astype(float), "bits": [packed(presence(t or "", DIMS)) for t in pdf["text"]], "style": [style(t or "") for t in pdf["text"]]})

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_y").alias("_y")).select("text", "_y").mapInPandas(features, "y double, bits binary, style array<double>").collect()
    rows.sort(key=lambda r: (bytes(r["bits"]), r["style"], r["y"]))
    if not rows:
        return Classifier(np.zeros(DIMS + 8), 0.0)
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8)).reshape(len(rows), -1)
    x = np.concatenate((bits.astype(np.float64) / 32, np.array([r["style"] for r in rows])), axis=1)
    y = np.array([r["y"] for r in rows])
    # Newton steps on the ridge-penalised likelihood, in the smaller of both dimensions
    w, b, penalty = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), 0.3
    mean = x.mean(0)
    centred = x - mean
    velocity, rate = np.zeros_like(w), 4.0 / (np.linalg.norm(centred, 2) ** 2 / len(y) + penalty / len(y) * 4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(centred @ w + b, -30, 30)))
        velocity = 0.9 * velocity - rate * (centred.T @ (p - y) / len(y) + penalty * w / len(y))
        w += velocity
        b -= np.mean(p - y)
    return Classifier(w, float(b - mean @ w))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def score(docs: DataFrame, classifier: Classifier, site: Column, path: Column, floor: float = 0.2, broadcast_paths: int = 200_000) -> DataFrame:
    """docs with p_doc, site_mean, path_mean (posteriors), quality_score and kept (score of floor or more) in place of text.

    A null text counts as empty; null sites and paths are groups of their own. All documents, repeated rows too, count in their groups;
    the groups' sums are made before the shuffle. Posteriors are broadcast if there are broadcast_paths paths at most. Texts are classified once, and what follows reads the written probabilities.
    Columns named like a result are replaced, the others stay. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark, 256)
    model = spark.sparkContext.broadcast(classifier)  # a fixed size

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.probability([t or "" for t in texts]) if len(texts) else [], dtype=float)

    results = ["p_doc", "site_mean", "path_mean", "quality_score", "kept"]
    held = docs.drop(*results)
    at, below = fresh(held, "site", "path")
    others = [c for c in held.columns if c.lower() != "text"]
    judged = written(held.withColumns({at: site, below: path}).withColumn("p_doc", own("text")).drop("text"))
    p = F.col("p_doc")
    paths = judged.groupBy(F.col(at).alias("site"), F.col(below).alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # prior strength by moments: the spread of group means beyond what documents' own spread explains
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")).first()
    n, s, q, k, b = (float(x or 0) for x in whole)
    mean = s / n if n else 0.5
    within = max((q - b) / max(n - k, 1), 1e-6)
    between = max((b - s * s / max(n, 1)) / max(k - 1, 1) - within, 0) / max(n / max(k, 1), 1)
    strength = float(min(max(within / max(between, 1e-9), 1.0), 1e4))
    site_mean = sites.select(F.col("site").alias("a"), ((F.col("s") + strength * mean) / (F.col("n") + strength)).alias("site_mean"))
    shrunk = (F.col("s") + strength * F.col("site_mean")) / (F.col("n") + strength)
    path_mean = written(paths.join(site_mean, F.col("site").eqNullSafe(F.col("a"))).select("site", "path", "site_mean", shrunk.alias("path_mean")))
    dealt, salted, same = judged, F.broadcast(path_mean), F.lit(True)
    if path_mean.count() > broadcast_paths:  # then a path's row goes to every salt, and its documents are dealt over the salts
        (salt,) = fresh(judged, "salt")
        dealt = judged.withColumn(salt, F.pmod(F.xxhash64(*judged.columns), F.lit(SALTS)).cast("int"))
        salted = path_mean.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = dealt[salt] == salted["_at"]
    joined = dealt.join(salted, dealt[at].eqNullSafe(path_mean["site"]) & dealt[below].eqNullSafe(path_mean["path"]) & same)
    odds = _logit(F.col("p_doc")) + _logit(F.col("path_mean")) - _logit(F.lit(mean))
    means = {c: path_mean[c] for c in ("site_mean", "path_mean")}
    scored = joined.select(*[dealt[c] for c in others], dealt["p_doc"], *means.values(), (1 / (1 + F.exp(-odds))).alias("quality_score"))
    return scored.withColumn("kept", F.col("quality_score") >= floor)
