"""Nearest neighbours of a set of query vectors among all vectors, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.session import written


def _chunks(vectors: DataFrame, id_col: str, vec_col: str, rows: int) -> DataFrame:
    """(dim, ids, data): unit vectors of one length, up to `rows` of them in a matrix."""
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"))
    # A vector with a missing number, or of length nought, has no direction.
    own = own.where(F.col("id").isNotNull() & (F.col("dim") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))).where(F.exists("vec", lambda x: x != 0))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pd.DataFrame:
            ids, vecs = held.pop(dim)
            data = np.array(vecs, np.float64)
            data /= np.linalg.norm(data, axis=1)[:, None]
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64)], "data": [data.tobytes()]})

        for b in batches:
            for i, vec, dim in zip(b["id"], b["vec"], b["dim"], strict=True):
                ids, vecs = held.setdefault(dim, ([], []))
                ids.append(i)
                vecs.append(vec)
                if len(ids) >= rows:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return written(own.mapInPandas(gather, "dim int, ids array<bigint>, data binary"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024, rows: int = 16_384) -> DataFrame:
    """(query_id, id, cosine, place): the k vectors of highest cosine for every query, itself left out; ties go to the smaller id.

    Blocks of queries meet blocks of vectors, one matrix product each, so what
    travels is the k best of each query in a block. Vectors meet those of their
    own length only; null or zero vectors are nobody's neighbours. A repeated id
    counts as often as it stands there.
    """
    left = _chunks(queries, id_col, vec_col, block).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # The stated query set against all rows, block by block.
    pairs = left.crossJoin(_chunks(vectors, id_col, vec_col, rows)).where("q_dim = dim").drop("q_dim")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_ids, q_data, dim, ids, data in zip(b["q_ids"], b["q_data"], b["dim"], b["ids"], b["data"], strict=True):
                q, ids = np.asarray(q_ids), np.asarray(ids)
                cosine = (np.frombuffer(q_data).reshape(-1, dim) @ np.frombuffer(data).reshape(-1, dim).T).round(9)
                cosine[q[:, None] == ids] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, cosine.shape), -cosine), axis=1)[:, :k]
                best = np.take_along_axis(cosine, order, axis=1)
                row, col = np.nonzero(best > -np.inf)
                yield pd.DataFrame({"query_id": q[row], "id": ids[order[row, col]], "cosine": best[row, col]})

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return pairs.mapInPandas(score, "query_id bigint, id bigint, cosine double").withColumn("place", place).where(F.col("place") <= k)
