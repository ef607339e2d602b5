"""Vectors: the text encoder plug-in (X2) and cosine similarity.

The default encoder is deterministic and offline: hashed word uni- and
bi-grams (``HashingTF``) scaled to unit length, all inside the JVM. A
neural sentence encoder can be plugged in with :func:`embed_pandas`, which
loads the model once per Python worker and encodes Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import col_of


def cosine(a, b) -> Column:
    """Cosine similarity of two ``array<float|double>`` columns, in double."""
    x, y = col_of(a), col_of(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                      F.lit(0.0), lambda acc, v: acc + v)
    nx = F.sqrt(F.aggregate(F.transform(x, lambda p: p.cast("double") * p.cast("double")),
                            F.lit(0.0), lambda acc, v: acc + v))
    ny = F.sqrt(F.aggregate(F.transform(y, lambda p: p.cast("double") * p.cast("double")),
                            F.lit(0.0), lambda acc, v: acc + v))
    return F.try_divide(dot, nx * ny)


def embed_hashed(df: DataFrame, text_col: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """X2 default: unit-length hashed uni+bi-gram vector as ``array<float>``.

    Equal texts give equal vectors; the whole computation is JVM-side
    (``RegexTokenizer`` -> ``NGram`` -> ``HashingTF`` -> ``Normalizer``).
    """
    from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text_col, outputCol="__w", pattern=r"\p{L}+", gaps=False,
                         toLowercase=True)
    grams = NGram(n=2, inputCol="__w", outputCol="__b")
    d = grams.transform(tok.transform(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))))
    d = d.withColumn("__g", F.concat("__w", "__b"))
    tf = HashingTF(numFeatures=dim, inputCol="__g", outputCol="__tf")
    norm = Normalizer(inputCol="__tf", outputCol="__v", p=2.0)
    v = norm.transform(tf.transform(d))
    return v.withColumn(out, vector_to_array("__v", "float32")).drop("__w", "__b", "__g", "__tf", "__v")


def embed_pandas(encoder_factory: Callable[[], Callable[[list[str]], "list"]], dim: int):
    """X2 plug-in: ``pandas_udf`` that encodes text batches with a model.

    ``encoder_factory`` runs once per Python worker and returns a function
    mapping a list of texts to a list of vectors of length ``dim``.
    """
    cache: dict = {}

    @F.pandas_udf("array<float>")
    def _enc(s: pd.Series) -> pd.Series:
        fn = cache.get("fn")
        if fn is None:
            fn = cache["fn"] = encoder_factory()
        vecs = fn(s.fillna("").tolist())
        return pd.Series([list(map(float, v)) for v in vecs])

    return _enc
