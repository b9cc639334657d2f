"""Vectors: hash embeddings, cosine, exact top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import cut_lineage
from .text import lit_let

DEFAULT_DIM = 64
MAX_BROADCAST_QUERIES = 20_000
BLOCK_ROWS = 4_096
#: Numbers of one block of scores in a task, and bytes of the queries of one round.
MAX_CELLS = 8_000_000
MAX_QUERY_BYTES = 32_000_000


def hash_embed(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Deterministic unit vector: SHA-256 digests of text and counter, bytes scaled to [-1, 1)."""
    return digest_embed(text_digest(text, dim), dim)


def text_digest(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """What :func:`hash_embed` makes of a text before it makes a vector of it; short, so it can travel in place of the text."""
    return F.concat(*[F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(f"{i:04x}"))), 256) for i in range(-(-dim // 32))])


def digest_embed(digest: Column, dim: int = DEFAULT_DIM) -> Column:
    return lit_let(digest, lambda h: lit_let(_bytes(h, dim), normalized))


def _bytes(digest_hex: Column, dim: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (F.conv(F.substring(digest_hex, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128.0) / 128.0,
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length, 1 for the zero vector."""
    return lit_let(F.sqrt(_dot(a, a)), lambda n: F.when(n == 0.0, F.lit(1.0)).otherwise(n))


def normalized(a: Column) -> Column:
    return lit_let(norm(a), lambda n: F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (norm(a) * norm(b))


def check_dim(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Fail the query on a vector of the wrong length."""
    ok = F.assert_true(F.size(column) == dim, F.lit(f"{column} is not of dimension {dim}")).isNull()
    return df.filter(ok)


def _matrix(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m


def _norms(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(_row_sums(m * m))
    n[n == 0.0] = 1.0
    return n


def _row_sums(products: np.ndarray) -> np.ndarray:
    """Left-to-right sums, so equal vectors get equal scores wherever they stand."""
    total = np.zeros(products.shape[0])
    for i in range(products.shape[1]):
        total = total + products[:, i]
    return total


class _Best:
    """The k best groups of every query among the vectors seen so far: at most k rows per query.

    A matrix product selects; whatever could still be among the best is scored again in a fixed order of summation, so ties are
    real ties and break by ``ord``. Vectors below a query's k-th score so far are not looked at again.
    """

    SLACK = 1e-9

    def __init__(self, queries: np.ndarray, k: int, grouped: bool):
        self.q, self.norms, self.k, self.grouped = queries, _norms(queries), k, grouped
        self.floor = np.full(len(queries), -np.inf)
        self.kept: pd.DataFrame | None = None

    def add(self, part: pd.DataFrame) -> None:
        v, ords = _matrix(part["embedding"]), part["ord"].to_numpy()
        lengths = _norms(v)
        groups = pd.factorize(part["grp"])[0] if self.grouped else np.arange(len(part))
        rough = (self.q @ v.T) / (self.norms[:, None] * lengths[None, :])
        which, rows, scores = [], [], []
        for i in np.flatnonzero(rough.max(axis=1) >= self.floor - self.SLACK):
            near = self._near(rough[i], self.floor[i], groups)
            exact = _row_sums(v[near] * self.q[i]) / (self.norms[i] * lengths[near])
            order = np.lexsort((ords[near], -exact))
            first = np.sort(np.unique(groups[near[order]], return_index=True)[1])[: self.k]
            which.append(np.full(len(first), i))
            rows.append(near[order[first]])
            scores.append(exact[order[first]])
        if rows:
            found = part.drop(columns="embedding").iloc[np.concatenate(rows)].assign(query=np.concatenate(which), score=np.concatenate(scores))
            self._merge(found)

    def _near(self, row: np.ndarray, floor: float, groups: np.ndarray) -> np.ndarray:
        """Places that may hold one of the k best groups: as many of the best as have k groups, and their ties."""
        near = np.flatnonzero(row >= floor - self.SLACK)
        n = self.k
        while n < len(near):
            limit = np.partition(row[near], len(near) - n)[len(near) - n]
            if len(np.unique(groups[near[row[near] >= limit]])) >= self.k:
                return near[row[near] >= limit - self.SLACK]
            n *= 2
        return near

    def _merge(self, found: pd.DataFrame) -> None:
        both = found if self.kept is None else pd.concat([self.kept, found])
        both = both.sort_values(["query", "score", "ord"], ascending=[True, False, True])
        if self.grouped:
            both = both.drop_duplicates(["query", "grp"])
        self.kept = both.groupby("query", sort=False).head(self.k)
        per_query = self.kept.groupby("query")["score"].agg(["size", "min"])
        full = per_query[per_query["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int, *, group: str | None = None, max_broadcast: int = MAX_BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine top-k: (query_id, id, ord, score, rank).

    ``queries`` has query_id and embedding; ``vectors`` has id, ord (unique, insertion order) and embedding. With ``group``, a
    string column of ``vectors`` without nulls, these are the k best groups, each by its best vector. Scores are block matrix
    products inside tasks; a task emits at most k rows per query, never its pairs. A query set of checked size travels to every
    vector partition. More queries than ``max_broadcast`` go in rounds of about ``block_rows``: a round reads every vector once,
    where it lies, and its result is written before the next one.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, id {id_type}, ord bigint, grp string, score double"
    grp = F.lit(None).cast("string") if group is None else F.col(group)
    v = vectors.select(
        "id", F.col("ord").cast("bigint").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"), grp.alias("grp")
    )
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n, numbers = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    rounds = max(1, -(-n // block_rows) if n > max_broadcast else 1, -(-numbers * 8 // MAX_QUERY_BYTES))
    out = None
    for r in range(rounds):
        own = q if rounds == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
        part, shared = _scan_with_queries(own, v, k, group is not None, schema)
        part = _ranked(part, k, group is not None)
        if rounds > 1:
            part = cut_lineage(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(part: DataFrame, k: int, grouped: bool) -> DataFrame:
    best = [F.desc("score"), F.asc("ord")]
    if grouped:
        own = Window.partitionBy("query_id", "grp").orderBy(*best)
        part = part.withColumn("__first", F.row_number().over(own)).filter("__first = 1").drop("__first")
    order = Window.partitionBy("query_id").orderBy(*best)
    return part.drop("grp").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan_with_queries(q: DataFrame, v: DataFrame, k: int, grouped: bool, schema: str):
    rows = q.collect()  # size checked by the caller
    ids = [r["query_id"] for r in rows]
    shared = q.sparkSession.sparkContext.broadcast((ids, _matrix([r["embedding"] for r in rows]) if rows else None))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = shared.value
        if not query_ids:
            return
        best, step = _Best(matrix, k, grouped), max(1, min(BLOCK_ROWS, MAX_CELLS // len(query_ids)))
        for b in batches:
            for at in range(0, len(b), step):
                best.add(b.iloc[at : at + step])
        if best.kept is not None:
            yield best.kept.assign(query_id=[query_ids[i] for i in best.kept["query"]])[["query_id", "id", "ord", "grp", "score"]]

    return v.mapInPandas(score, schema), shared
