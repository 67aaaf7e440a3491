"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors become int8 once, in Spark columns, with their scale and the norm of what rounding left. Queries
and candidates are dealt to a grid of (query block, candidate block) cells of ``CELL_BYTES`` at most; only
the int8 rows travel there. In a cell, tiles are multiplied in float32; each product comes with a bound on
its quantisation and rounding error, and heaps keep, for every query, the k best lower bounds and with them
the pairs whose upper bound reaches the k-th of those. Cells' survivors are merged against the k-th lower
bound over all cells, and only then are the original vectors fetched and the inner products recomputed in
double precision. No pair that could be among the k best is lost: the result is exact.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id; every row but the query's own is a candidate, rows that repeat an id too, and rows
that repeat a query's id are queries of their own; only vectors of a query's own length are its
candidates; equal scores go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CELL_BYTES, TILE = 8 << 20, 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components only, one of them not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, their norms, and the norms of what rounding left (a little more than either)."""
    top = np.abs(v).max(axis=1)
    unit = v / top[:, None]  # so that no square overflows or vanishes
    q = np.rint(unit * 127.0).astype(np.int8)
    slack = 1 + 1e-12 * v.shape[1]
    return q, top / 127.0, top * np.linalg.norm(unit, axis=1) * slack, top * (np.linalg.norm(unit - q / 127.0, axis=1) * slack + 1e-15)


def finer(v: np.ndarray, q: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A second int8 plane for what rounding left, in 254ths of a scale, and the norms of what that leaves (a little more)."""
    top = scales * 127.0
    rest = v / top[:, None] - q / 127.0
    f = np.rint(np.clip(rest * 127.0 * 254.0, -127, 127)).astype(np.int8)
    return f, top * (np.linalg.norm(rest - f / (127.0 * 254.0), axis=1) * (1 + 1e-12 * v.shape[1]) + 1e-15)


def in_order(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bounds(q8: np.ndarray, qs: np.ndarray, qn: np.ndarray, ql: np.ndarray, c8: np.ndarray, cs: np.ndarray, cn: np.ndarray, cl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of a tile: the int8 product, what quantisation left, and float32's rounding of the sum."""
    rough = (q8 @ c8.T).astype(np.float64) * qs[:, None] * cs[None, :]
    rounding = 127.0**2 * q8.shape[1] ** 2 * 2.0**-24 if 127**2 * q8.shape[1] >= 1 << 24 else 0.0  # whole numbers below 2**24 are exact
    error = ql[:, None] * cn[None, :] + (qn + ql)[:, None] * cl[None, :] + rounding * qs[:, None] * cs[None, :]
    error += 1e-9 * (np.abs(rough) + error) + 1e-12 * qn[:, None] * cn[None, :]
    return rough - error, rough + error


def prepared(tiles: np.ndarray, scales: np.ndarray, norms: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, float]:
    """Candidates as float32 rows, over the largest norm: the product with a row of ``asking`` is an upper bound, whatever float32 rounds off."""
    top, d = norms.max(), tiles.shape[1]
    rounding = 8 * (d + 8) * 2.0**-24 * (norms + left) / top + 1e-30  # a row of asking has a norm of at most 4, for left <= norms
    return np.concatenate([tiles * (scales / top)[:, None], norms[:, None] / top, (left / top + rounding)[:, None]], axis=1, dtype=np.float32, casting="same_kind"), top


def asking(tiles: np.ndarray, scales: np.ndarray, norms: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Queries as float32 rows, over their norms."""
    return np.concatenate([tiles * (scales / norms)[:, None], left[:, None] / norms[:, None], 1 + left[:, None] / norms[:, None]], axis=1, dtype=np.float32, casting="same_kind")


def raised(floors: np.ndarray, i: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The k largest of each row's floors and of the bounds found for it (``i`` ascending)."""
    rows, start, n = np.unique(i, return_index=True, return_counts=True)
    if len(rows):
        k = floors.shape[1]
        new = np.full((len(rows), k + n.max()), -np.inf)
        new[:, :k] = floors[rows]
        new[np.repeat(np.arange(len(rows)), n), k + np.arange(len(i)) - np.repeat(start, n)] = low
        floors[rows] = np.partition(new, n.max(), axis=1)[:, -k:]
    return floors


def best_of_cell(asked: tuple, had: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, lower, upper) of the pairs that can be among a query's k best; ``asked`` and ``had`` hold rows, int8 vectors, scales, norms and left norms.

    Tiles bound both sides, so memory grows with the rows of a cell and not with its pairs. The first tile has the full
    bounds of all its pairs; later ones have one float32 product, an upper bound, and lower bounds only where that reaches the floor.
    """
    (qrow, *asks), (crow, *cands) = asked, had
    every, top = prepared(*cands)
    found = []
    for at in range(0, len(qrow), max(1, TILE // 4)):
        own = slice(at, at + max(1, TILE // 4))
        i, j, low, high = _best_of_tile(qrow[own], [x[own] for x in asks], crow, cands, every, top, k)
        found.append((i + at, j, low, high))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best_of_tile(qrow: np.ndarray, asks: list[np.ndarray], crow: np.ndarray, cands: list[np.ndarray], every: np.ndarray, top: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, norm, n = asking(*asks), asks[2], max(1, TILE // 8)
    floors = np.full((len(qrow), k), -np.inf)  # heaps of the k largest lower bounds
    kept: list[tuple[np.ndarray, ...]] = []
    at, held, least = 0, 0, 1 << 20
    while at < len(crow):
        part = slice(at, at + n)
        if at == 0:
            low, high = (x.ravel() for x in bounds(asks[0].astype(np.float32), *asks[1:], cands[0][part].astype(np.float32), *(x[part] for x in cands[1:])))
            where = np.arange(len(low))
        else:
            with np.errstate(all="ignore"):
                floor = floors.min(axis=1) / norm / top
            floor[~np.isfinite(floor) | (norm * top < 1e-290)] = -np.inf
            product = a @ every[part].T
            where = np.flatnonzero(product >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
        i, j = np.divmod(where, len(crow[part]))
        other = qrow[i] != crow[part][j]
        i, j, where = i[other], j[other], where[other]
        if at == 0:
            low, high = low[where], high[where]
        else:
            over = product.ravel()[where].astype(np.float64)
            error = (a[i, -2:].astype(np.float64) * every[part][j, -2:]).sum(axis=1)
            low, high = (over - 2.001 * error) * norm[i] * top, over * norm[i] * top
        floors = raised(floors, i, low)
        kept.append((i, j + at, low, high))
        held += len(i)
        at, n = at + n, min(TILE, n * 2)
        if held > least:  # what lower floors let in goes before more is held
            kept = [_reaching(kept, floors)]
            held = len(kept[0][0])
            least = max(1 << 20, 2 * held)
    return _reaching(kept, floors)


def _reaching(kept: list[tuple[np.ndarray, ...]], floors: np.ndarray) -> tuple[np.ndarray, ...]:
    i, j, low, high = (np.concatenate(x) for x in zip(*kept))
    sure = high >= floors.min(axis=1)[i]
    return i[sure], j[sure], low[sure], high[sure]


def refined(i: np.ndarray, j: np.ndarray, asked: tuple, had: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs of a cell that can still be among a query's k best by both planes, with these bounds; sides hold int8 vectors, scales, norms, second planes and what those leave."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    (q8, qs, qn, qf, ql), (c8, cs, cn, cf, cl) = asked, had
    mid = np.empty(len(i))
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        mid[at : at + (1 << 14)] = np.einsum("nd,nd->n", q8[a] + qf[a] / 254.0, c8[b] + cf[b] / 254.0) * qs[a] * cs[b]
    error = ql[i] * cn[j] + (qn + ql)[i] * cl[j] + 1e-9 * np.abs(mid) + 1e-12 * (1 + q8.shape[1]) * qn[i] * cn[j]
    floors = raised(np.full((len(q8), k), -np.inf), i, mid - error)
    return _reaching([(i, j, mid - error, mid + error)], floors)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query among all other rows."""
    scratch = scratch or Scratch(vectors.sparkSession)
    good = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = scratch.save(good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.size(vector_col).alias("d")).withColumn("row", F.monotonically_increasing_id()))

    def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("d").to_numpy()
            for d in np.unique(length):
                own = b.filter(pa.array(length == d))
                q, s, n, left = quantise(np.asarray(own.column("v").flatten(), np.float64).reshape(own.num_rows, -1))
                f, rest = finer(np.asarray(own.column("v").flatten(), np.float64).reshape(own.num_rows, -1), q, s)
                tiny, fine = (pa.array([x.tobytes() for x in p], pa.binary()) for p in (q, f))
                yield pa.RecordBatch.from_pydict({"d": own.column("d"), "row": own.column("row"), "q": own.column("q"), "tiny": tiny, "s": pa.array(s), "n": pa.array(n), "l": pa.array(left), "fine": fine, "r": pa.array(rest)})

    tiny = scratch.save(rows.select("v", "d", "row", "q").mapInArrow(small, "d int, row bigint, q boolean, tiny binary, s double, n double, l double, fine binary, r double"))
    n, nq, total, asked_bytes = tiny.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("d") + 40), F.lit(0)), F.coalesce(F.sum(F.when(F.col("q"), F.col("d") + 40)), F.lit(0))).first()
    nc, nb = max(1, -(-total // CELL_BYTES)), max(1, -(-asked_bytes // CELL_BYTES))
    block = lambda m, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    cands = tiny.drop("q").withColumn("c", block(nc, 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    asks = tiny.where("q").drop("q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).withColumn("b", block(nb, 2))
    schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def cell(asked: pa.Table, had: pa.Table) -> pa.Table:
        if not asked.num_rows or not had.num_rows:
            return schema.empty_table()
        grid = lambda t, plane: np.frombuffer(b"".join(t.column(plane).to_pylist()), np.int8).reshape(t.num_rows, -1)
        parts = lambda t: (t.column("row").to_numpy(), grid(t, "tiny"), *(t.column(x).to_numpy() for x in "snl"))
        a, b = parts(asked), parts(had)
        i, j, _, _ = best_of_cell(a, b, k)
        i, j, low, high = refined(i, j, *((*x[1:4], grid(t, "fine"), t.column("r").to_numpy()) for x, t in ((a, asked), (b, had))), k)
        return pa.table({"q": a[0][i], "c": b[0][j], "low": low, "high": high}, schema)

    found = asks.groupBy("d", "c", "b").cogroup(cands.groupBy("d", "c", "b")).applyInArrow(cell, "q bigint, c bigint, low double, high double")
    found = scratch.save(found)
    scratch.drop(tiny)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    floor = found.select("q", "low", place.alias("place")).where(F.col("place") == k).select(F.col("q").alias("fq"), F.col("low").alias("floor"))
    able = found.join(floor, F.col("q") == F.col("fq"), "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("q", "c")
    ask = rows.where("q").select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
    had = rows.select(F.col("row").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("cv"))
    scored = able.join(ask, "q").join(had, "c").select("q", "query_id", "vec_id", in_order(F.col("qv"), F.col("cv")).alias("score"))
    merged = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", merged).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
