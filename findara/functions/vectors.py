"""Dense vectors as arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for a null or zero vector."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.when(size > 1e-12, dot(a, b) / size), F.lit(0.0))


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the last hidden states (texts x tokens x dimensions) of the tokens that the mask (texts x tokens) keeps."""
    weight = mask[:, :, None].astype(np.float32)
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], most: int = 32) -> Callable[[Column], Column]:
    """An expression from texts to vectors (arrays of doubles) by a model of the user's.

    ``load`` gives the model, a function from texts to a matrix, once a task; it gets ``most`` texts at a time.  Null
    texts count as empty.
    """
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    def encode(batches):  # noqa: ANN001, ANN202 (told by the type below)
        model = load()
        for texts in batches:
            texts = texts.fillna("").tolist()
            yield pd.Series([row.astype(float).tolist() for k in range(0, len(texts), most) for row in np.asarray(model(texts[k : k + most]))], dtype=object)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(encode, "array<double>")
