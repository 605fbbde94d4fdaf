"""Tokens for encoders: ids, masks and segment types of texts that fit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokenize(texts: DataFrame, tokenizer_path: str, text: str = "text", most: int = 512) -> DataFrame:
    """texts with input_ids, attention_mask and token_type_ids; texts of more than `most` tokens are dropped, not cut.

    The tokenizer is a `tokenizers` file; it's loaded once a Python worker.
    """

    @F.pandas_udf("array<long>")
    def ids(batch: pd.Series) -> pd.Series:
        tok = _load(tokenizer_path)
        return pd.Series([e.ids for e in tok.encode_batch([t or "" for t in batch])], dtype=object)

    found = texts.withColumn("input_ids", ids(text)).where(F.size("input_ids") <= most)
    return found.withColumns({"attention_mask": F.transform("input_ids", lambda x: F.lit(1).cast("long")), "token_type_ids": F.transform("input_ids", lambda x: F.lit(0).cast("long"))})


_loaded: dict = {}


def _load(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def embed(tokens: DataFrame, model_path: str, dims: int = 384) -> DataFrame:
    """tokens with embedding: mean of the model's last hidden states over unmasked tokens; the ONNX session is built once a worker."""

    @F.pandas_udf("array<float>")
    def run(ids: pd.Series, mask: pd.Series) -> pd.Series:
        import numpy as np

        if model_path not in _loaded:
            import onnxruntime

            _loaded[model_path] = onnxruntime.InferenceSession(model_path)
        out = []
        for i, m in zip(ids, mask):
            feed = {"input_ids": np.array([i], dtype=np.int64), "attention_mask": np.array([m], dtype=np.int64), "token_type_ids": np.zeros((1, len(i)), np.int64)}
            names = {x.name for x in _loaded[model_path].get_inputs()}
            states = _loaded[model_path].run(None, {k: v for k, v in feed.items() if k in names})[0][0]
            on = np.array(m, bool)
            out.append(states[on].mean(0).tolist() if on.any() else [0.0] * dims)
        return pd.Series(out, dtype=object)

    return tokens.withColumn("embedding", run("input_ids", "attention_mask"))
