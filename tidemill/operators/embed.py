"""Batched embedding of a text column by a user's embedder."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import fixed, text


def embed_column(
    df: DataFrame,
    embedder: Callable[[list, str], list],
    source: str = "embed_text",
    target: str = "embedding",
    batch: int = fixed.EMBED_BATCH,
    mode: str = "passage",
    limit: int | None = None,
) -> DataFrame:
    """Adds a vector per row; the embedder gets at most `batch` texts per call, in row order.

    Texts are passed whole; an embedder that takes only so many characters gets them cut to
    `limit` (`fixed.EMBEDDER_INPUT_CHARS` for the usual one). `mode` is passed on: passages and queries may
    be embedded differently. An embedder error fails the task, which Spark then retries.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import pandas as pd

        for texts in parts:
            vectors = []
            for start in range(0, len(texts), batch):
                chunk = texts.iloc[start : start + batch].tolist()
                answer = embedder(chunk, mode)
                if len(answer) != len(chunk):
                    raise ValueError(f"{len(chunk)} texts gave {len(answer)} vectors")
                vectors.extend(np.asarray(vector, dtype="float32") for vector in answer)
            yield pd.Series(vectors, dtype=object)

    call = F.pandas_udf(run, "array<float>")
    whole = F.coalesce(F.col(source), F.lit(""))
    return df.withColumn(target, call(whole if limit is None else text.truncate(whole, limit)))


def hash_embedder(dim: int = fixed.EMBEDDING_DIM) -> Callable[[list, str], list]:
    """A stand-in embedder with the values of `vectors.hash_embedding`."""

    def embed(texts: list, mode: str) -> list:
        import hashlib

        import numpy as np

        digests = [hashlib.sha256(item.encode()).digest() for item in texts]
        values = np.frombuffer(b"".join(digests), dtype="uint8").reshape(-1, 32)
        return np.tile(values / 255.0 - 0.5, (1, -(-dim // 32)))[:, :dim]

    return embed


def embed_queries(df: DataFrame, embedder, source: str = "query", **options) -> DataFrame:
    return embed_column(df, embedder, source, mode="query", **options)
