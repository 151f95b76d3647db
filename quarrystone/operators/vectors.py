"""Nearest-neighbour retrieval over embeddings, exact.

One query is ranked by SQL functions.  A query set meets the rows in cells, a block of queries by
a slice of the rows, which Spark deals out; each cell returns only what can be among a query's best k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

MOST_QUERIES = 2000  # about so many queries and rows in a cell
MOST_ROWS = 8192
_AT_ONCE = 256  # queries of a cell that are scored together


def squared_distance(a: Column, b: Column) -> Column:
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, query: Column, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows nearest to one query vector, with their distance; ties by key."""
    return vectors.withColumn("distance", F.round(F.sqrt(squared_distance(F.col(vector), query)), 4)).orderBy("distance", key).limit(k)


def _rows_by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, rows as a matrix) of the vectors that are not null and hold no null."""
    own = column.combine_chunks()
    good = np.asarray(pc.is_valid(own))
    if pc.list_flatten(own).null_count:
        good[np.asarray(pc.list_parent_indices(own))[np.asarray(pc.is_null(pc.list_flatten(own)))]] = False
    lengths = np.asarray(pc.fill_null(pc.list_value_length(own), -1))
    out = {}
    for n in np.unique(lengths[good]):
        at = np.flatnonzero(good & (lengths == n))
        out[int(n)] = at, np.asarray(pc.list_flatten(own.take(pa.array(at))).cast(pa.float64())).reshape(len(at), int(n))
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows, their squares added from the first component to the last as in SQL."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        gap = a[:, i] - b[:, i]
        out += gap * gap
    return np.sqrt(out)


def _near(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row), by query, of which every query's best k are some, by a product of matrices less its error; all pairs where that can overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        qq, vv = (q * q).sum(1), (v * v).sum(1)
        tame_q, tame_v = qq < 1e300, vv < 1e300
        sums = qq[:, None] + vv[None, :]
        squares = sums - 2 * (q @ v.T)
        error = 4 * (q.shape[1] + 4) * np.finfo(float).eps * sums
        error += 1e-300
    both = tame_q[:, None] & tame_v[None, :]
    most = np.where(both, squares + error, np.inf)
    if len(v) > k:
        most.partition(k - 1, axis=1)
        # Distances that are rounded alike are at most one unit of the fourth digit apart.
        bound = np.sqrt(np.maximum(most[:, k - 1], 0)) * (1 + 1e-12) + 1.001e-4
        near = ~both | (squares - error <= (bound * bound)[:, None])
    else:
        near = np.ones(squares.shape, bool)
    return np.nonzero(near)


def _best(at: np.ndarray, distance: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs of queries (``at``, ascending) can be among the k least by rounded distance, then order.

    What lies too near to a half to say how it is rounded stays.
    """
    scaled = distance * 1e4 + 0.5
    doubt = 1e-3 + np.abs(scaled) * 4e-16
    special = ~np.isfinite(scaled)
    lo, hi = np.floor(np.where(special, 0, scaled - np.where(special, 0, doubt))), np.floor(np.where(special, 0, scaled + np.where(special, 0, doubt)))
    lo[special] = hi[special] = np.inf
    nan = np.isnan(distance)
    # the k-th of each query by the larger rounding is the bound
    by = np.lexsort((nan, hi, at))
    first = np.searchsorted(at[by], at)
    place = first + k - 1
    inside = (place < len(by)) & (at[by][np.minimum(place, len(by) - 1)] == at)
    bound = np.where(inside, hi[by][np.minimum(place, len(by) - 1)], np.inf)
    keep = lo <= bound
    # of those that are surely rounded to the same value only the k first in order can count
    kept = np.flatnonzero(keep)
    sure = kept[lo[kept] == hi[kept]]
    tied = sure[np.lexsort((order[sure], nan[sure], lo[sure], at[sure]))]
    if len(tied) > k:
        same = (at[tied][k:] == at[tied][:-k]) & (lo[tied][k:] == lo[tied][:-k]) & (nan[tied][k:] == nan[tied][:-k])
        keep[tied[k:][same]] = False
    return np.flatnonzero(keep)


def _cell(rows: pa.Table, queries: pa.Table, k: int, names: tuple[str, str]) -> pa.Table:
    """The rows of a cell that can be among the best k of its queries, with the distance before it is rounded; null comes last."""
    vector, key, query_key = "__vector", *names
    if not rows.num_rows or not queries.num_rows:
        return pa.table([rows[key].slice(0, 0), queries[query_key].slice(0, 0), pa.nulls(0, pa.float64())], names=[key, query_key, "distance"])
    order = np.empty(rows.num_rows, np.int64)
    order[np.asarray(pc.sort_indices(rows[key].combine_chunks(), null_placement="at_start"))] = np.arange(rows.num_rows)
    own, asked = _rows_by_length(rows[vector]), _rows_by_length(queries[vector])
    found_q, found_v, found_d = [], [], []
    missing = np.full(queries.num_rows, k)
    for n, (places, q) in asked.items():
        if n not in own:
            continue
        at, v = own[n]
        missing[places] = max(k - len(at), 0)
        for start in range(0, len(q), _AT_ONCE):
            some = q[start : start + _AT_ONCE]
            i, j = _near(some, v, k)
            d = np.empty(len(i))
            with np.errstate(over="ignore", invalid="ignore"):
                for cut in range(0, len(i), 1 << 18):
                    part = slice(cut, cut + (1 << 18))
                    d[part] = _distances(some[i[part]], v[j[part]])
            best = _best(i, d, order[at[j]], k)
            found_q.append(places[start + i[best]])
            found_v.append(at[j[best]])
            found_d.append(d[best])
    lasts = pa.nulls(0, pa.float64())
    short = np.flatnonzero(missing)
    if len(short):
        by_order = np.argsort(order)
        for n in {-1, *asked}:
            asking = np.setdiff1d(short, np.concatenate([p for p, _ in asked.values()])) if n == -1 and asked else short if n == -1 else np.intersect1d(short, asked[n][0])
            comparable = own[n][0] if n in own else np.empty(0, np.int64)
            others = by_order[~np.isin(by_order, comparable)][:k]
            found_q.append(np.repeat(asking, len(others)))
            found_v.append(np.tile(others, len(asking)))
        lasts = pa.nulls(sum(map(len, found_q)) - sum(map(len, found_d)), pa.float64())
    whole = lambda parts: np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)
    distance = pa.concat_arrays([pa.array(np.concatenate([np.empty(0), *found_d])), lasts])
    return pa.table([rows[key].take(pa.array(whole(found_v))), queries[query_key].take(pa.array(whole(found_q))), distance], names=[key, query_key, "distance"])


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", query_key: str = "query_id", within: str | None = None) -> DataFrame:
    """The k nearest rows of each query (query_key, vector), of a query set of any size against all rows.

    Queries are dealt into blocks of about ``MOST_QUERIES`` and rows into slices of about ``MOST_ROWS``;
    every block meets every slice in a task's cell, which returns at most a few times k rows of each query.
    With ``within``, a column of both, a query meets only rows that are equal in it; null is equal to nothing.
    Distances that are null come last.
    """
    if within is not None:
        queries, vectors = queries.where(F.col(within).isNotNull()), vectors.where(F.col(within).isNotNull())
    same = F.lit(0) if within is None else F.col(within)
    rows = vectors.select(F.col(key), F.col(vector).alias("__vector"), same.alias("__same"))
    asked = queries.select(F.col(query_key), F.col(vector).alias("__vector"), same.alias("__same"))
    parts = lambda df, most, name: df.groupBy("__same").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = parts(rows, MOST_ROWS, "__slices").join(parts(asked, MOST_QUERIES, "__blocks"), "__same")
    sizes = F.broadcast(sizes) if within is None else sizes
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = ["__same", "__slice", "__block"]
    # A number that is stated isn't lowered by the size of the cells, which is small for what they cost.
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.join(sizes, "__same").select(key, "__vector", "__same", deal(key, "__slices").alias("__slice"), every("__blocks").alias("__block")).repartition(n, *at)
    met = asked.join(sizes, "__same").select(query_key, "__vector", "__same", deal(query_key, "__blocks").alias("__block"), every("__slices").alias("__slice")).repartition(n, *at)
    schema = S.StructType([vectors.schema[key], queries.schema[query_key], S.StructField("distance", S.DoubleType())])
    names = (key, query_key)
    scored = own.groupBy(*at).cogroup(met.groupBy(*at)).applyInArrow(lambda v, q: _cell(v, q, k, names), schema)
    scored = scored.withColumn("distance", F.round("distance", 4))
    w = Window.partitionBy(query_key).orderBy(F.col("distance").asc_nulls_last(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- Index: a table of embedded chunks in a folder, by the folder they come from ----


def source_folder(path: Column, root: str) -> Column:
    """The first part of a path below the root; "root" for files right in it, "unknown" for others."""
    base = root.rstrip("/") + "/"
    rest = F.substr(path, F.lit(len(base) + 1))
    return F.when(~F.coalesce(F.startswith(path, F.lit(base)), F.lit(False)), "unknown").when(F.contains(rest, F.lit("/")), F.get(F.split(rest, "/"), F.lit(0))).otherwise("root")


def write_index(chunks: DataFrame, path: str, add: bool = False) -> None:
    """Write embedded chunks (id, embedding, text, source_folder, ...), one folder for each source folder, or add to those that are there."""
    chunks.write.mode("append" if add else "overwrite").partitionBy("source_folder").parquet(path)


def load_index(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The index, or the part of one source folder, which alone is read then."""
    found = spark.read.option("basePath", path).parquet(path)
    return found if folder is None else found.where(F.col("source_folder") == folder)


def index_status(index: DataFrame) -> DataFrame:
    """Chunks by source folder."""
    return index.groupBy("source_folder").agg(F.count("*").alias("chunks"))


def contexts(hits: DataFrame, preview: int = 200, by: str | None = None) -> DataFrame:
    """The texts of a search's hits (distance, id, text) in order as context, and their beginnings: one row, or one for each search where ``by`` names it.

    The hits are the k of each search.  Hits without a text add nothing.
    """
    ordered = F.array_sort(F.collect_list(F.struct("distance", "id", "text")))
    found = hits.where("text is not null").groupBy(*([by] if by else [])).agg(ordered.alias("h"))
    return found.select(*([by] if by else []), F.array_join(F.transform("h", lambda x: x["text"]), "\n\n").alias("context"), F.transform("h", lambda x: F.substr(x["text"], F.lit(1), F.lit(preview))).alias("previews"))
