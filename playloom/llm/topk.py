"""Exact top-k search by inner product over vector-approximation files.

The corpus is cut into blocks, the stated queries into groups; each (block,
group) cell of that grid is one unit of work. A block holds the approximation
of its vectors, the cell number of each component on the block's own quantile
grid, beside the exact vectors. A query first scans the approximations: the
cells' bounds give an upper bound of each score. It then reads exact vectors in
the order of that bound and stops when the k-th score found is above every
bound left. Only k candidates of each cell and query go on to the final rank.

Scale: a block has about ``block_rows`` vectors and a group about
``group_rows`` queries whatever the input size, so memory is bounded; blocks
repeat once per query group. Equal vectors in a block are searched once, with
their k + 1 smallest ids, so a very common vector makes no long read. The final
rank limits rows before the shuffle.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; scores that 64 bits cannot hold are ranked exactly and
given as the nearest number that fits; vectors meet only vectors of their own length; ties go
to the smaller id; a query never finds its own id; of several vectors of one id
the best score counts, once for each query id; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
GROUP_ROWS = 4096
#: Cells of each component in the approximation (4 bits).
CELLS = 16
#: Exact vectors read per step.
STEP = 32


class ApproximationFile:
    """Cell numbers of a block's vectors and the borders of the cells."""

    def __init__(self, exact: np.ndarray):
        order = np.sort(exact, axis=0)
        at = np.linspace(0, len(exact) - 1, CELLS + 1).round().astype(int)
        self.borders = order[at]  # smallest and largest values close the outer cells, so bounds hold for every vector
        self.cells = np.empty(exact.shape, np.uint8)
        for j in range(exact.shape[1]):
            self.cells[:, j] = np.clip(np.searchsorted(self.borders[:, j], exact[:, j], side="right") - 1, 0, CELLS - 1)

    def upper_bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and vector the largest inner product that the vector's cells allow."""
        column = np.arange(self.cells.shape[1])
        low, high = self.borders[self.cells, column], self.borders[self.cells.astype(np.int64) + 1, column]
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k best (score, then smaller id) of a block: lists of query id, vector id, score."""
    order = np.argsort(ids, kind="stable")
    exact, group = np.unique(vectors[order], axis=0, return_inverse=True)
    group = group.ravel()
    members: list[list[int]] = [[] for _ in range(len(exact))]
    for vec_id, g in zip(ids[order].tolist(), group.tolist()):
        if len(members[g]) <= k and vec_id not in members[g]:
            members[g].append(vec_id)
    # Floats hold these integer sums exactly up to 2**53; larger components are multiplied as integers.
    largest = max(int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (exact, queries))
    exact_floats = largest * largest * max(1, exact.shape[1]) < 1 << 53
    file = ApproximationFile(exact)
    out: tuple[list, list, list] = ([], [], [])
    for begin in range(0, len(queries), 256):
        part = queries[begin : begin + 256]
        bounds = file.upper_bounds(part.astype(np.float64)) if exact_floats else np.array(file_bounds_as_objects(file, part))
        for row, query in enumerate(part):
            own, bound = int(query_ids[begin + row]), bounds[row]
            best: list[tuple[int, int]] = []
            read, step, rest = np.zeros(len(exact), bool), STEP, np.arange(len(exact))
            while len(rest):
                nearest = rest[np.argpartition(-bound[rest], step)[:step]] if len(rest) > step else rest
                read[nearest] = True
                scores = exact[nearest] @ query if exact_floats else exact[nearest].astype(object) @ query.astype(object)
                keys = [(-int(score), vec_id) for score, g in zip(scores.tolist(), nearest.tolist()) for vec_id in members[g] if vec_id != own]
                best = _best_of_each(best + keys)[:k]
                rest = np.flatnonzero(~read)
                if len(best) == k:  # certain once no bound left reaches the k-th score
                    rest = rest[bound[rest] >= -best[-1][0]]
                step *= 2
            out[0].extend([own] * len(best))
            out[1].extend(vec_id for _, vec_id in best)
            out[2].extend(max(-(1 << 63), min((1 << 63) - 1, -score)) for score, _ in best)
    return out


def _best_of_each(keys: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(-score, id) in order, each id once with its best score."""
    best: dict[int, int] = {}
    for negative, vec_id in sorted(keys):
        best.setdefault(vec_id, negative)
    return [(negative, vec_id) for vec_id, negative in best.items()]


def file_bounds_as_objects(file: ApproximationFile, queries: np.ndarray) -> list:
    """The same bounds in whole numbers of any size."""
    wide = ApproximationFile.__new__(ApproximationFile)
    wide.cells, wide.borders = file.cells, file.borders.astype(object)
    return list(wide.upper_bounds(queries.astype(object)))


def search(vectors: DataFrame, is_query, k: int = 5, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, embedding) with ``is_query`` true, against all rows."""
    whole = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(double(x)) > 1.7976931348623157e308)"
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    valid = vectors.filter("vec_id is not null").filter(whole).select("vec_id", ints.alias("v"), F.size("embedding").alias("dim"), is_query.alias("asks"))
    one = valid.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    blocks, groups = -(-one["rows"] // block_rows) or 1, -(-one["queries"] // group_rows) or 1
    block, group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups))
    corpus = valid.select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "vec_id", "v")
    queries = valid.filter("asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group.cast("int").alias("group"), "vec_id", "v")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        def parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = t.column("vec_id").to_numpy()
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return ids, flat.reshape(len(ids), -1)

        found: tuple[list, list, list] = ([], [], [])
        if asked.num_rows and held.num_rows:
            found = search_block(*parts(asked), *parts(held), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    keys = ("dim", "block", "group")
    found = (
        queries.withColumn("block", F.col("block").cast("long")).groupBy(*keys)
        .cogroup(corpus.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
