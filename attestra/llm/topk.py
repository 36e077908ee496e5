"""Exact top-k by inner product, with a pivot table that rules candidates out.

Each row keeps its distances to many pivots. The largest difference of two rows' distances
to a pivot is a lower bound of the distance between them, and so an upper bound of
their inner product. A first round scores each query against the bounded sample that pivots are
chosen from; its k-th score there goes with the query, and no candidate bounded below it is
evaluated anywhere. Queries meet candidates in blocks of bounded size. In a block, candidates
that lie alike to the pivots form tiles, and a tile's range of distances bounds all that it
holds. A query goes through the tiles in the order of their bounds, and stops at the first
whose bound is below its k-th score so far: no later one can hold any of the k best. In a tile
that it enters, the candidates' own bounds rule out those below the k-th score; only the others are
evaluated. The blocks' lists are merged by rank.

Components are floor(scale * x) as whole numbers, scores exact; bounds are widened by more than
their rounding error. Magnitudes up to 2**62 after scaling are supported.

Defined results: rows with a null id or vector, or a null or non-finite component, take no
part; a shorter vector counts as filled up with zeros, an empty one has score zero with
all. Rows that share the query's id aren't its candidates; other repeated rows each count.
A query id given more than once is searched with its least vector. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm import common as C

#: Rows of a block; rows that pivots are chosen from; pivots. None changes a result.
CANDIDATES, QUERIES, SAMPLE, PIVOTS = 8192, 2048, 1024, 64
#: Candidates of a tile; queries whose candidates are bounded at once; steps that distances to pivots are told in there.
_TILE, _AT_ONCE, _STEPS = 256, 256, 30_000
_LEAST = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(id_col: str, vector_col: str) -> Column:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of int64, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for row, part in zip(out, np.split(values, np.cumsum(sizes)[:-1])):
        row[: len(part)] = part
    return out


def _sample(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded sample of the rows."""
    found = rows.orderBy(F.xxhash64("id", "v"), "id").select("id", "v").limit(SAMPLE).collect()
    vectors = np.zeros((len(found), width), np.int64)
    for row, r in zip(vectors, found):
        row[: len(r.v)] = r.v
    return np.array([r.id for r in found], np.int64), vectors


def _pivots(vectors: np.ndarray) -> np.ndarray:
    """Pivots far from each other, out of a sample."""
    vectors = vectors.astype(np.float64)
    if not vectors.size:
        return vectors[:0]
    chosen, far = [0], np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(PIVOTS, len(vectors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(np.square(vectors - p).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(vectors), 0))


def _products(vectors: np.ndarray, queries: np.ndarray, plain: bool) -> np.ndarray:
    """(queries, vectors)"""
    if plain:  # below 2**53 all sums are exact
        return (queries.astype(np.float64) @ vectors.T).astype(np.int64)
    return (queries.astype(object) @ vectors.T.astype(object)).astype(np.int64)


def _exact(*sides: np.ndarray) -> bool:
    """Whether double sums of products are exact: below 2**52."""
    return float(max(np.abs(x).max(initial=0) for x in sides)) ** 2 * max(sides[0].shape[1], 1) < 2**52


def floors(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among a sample of the candidates; the least possible where it has fewer."""
    scores = np.where(query_ids[:, None] == ids, _LEAST, _products(vectors, queries, _exact(vectors, queries)))
    if len(ids) < k:
        return np.full(len(queries), _LEAST)
    return np.partition(scores, -k, axis=1)[:, -k]


class Tiles:
    """The candidates of a block, ordered by their nearest pivots and cut into tiles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        near = pivots.argmin(axis=1) if pivots.shape[1] else np.zeros(len(ids), np.int64)
        order = np.lexsort((pivots[np.arange(len(ids)), near] if pivots.shape[1] else near, near))
        self.ids, self.vectors, self.pivots = ids[order], vectors[order], pivots[order]
        cuts = np.arange(0, len(ids), _TILE)
        self.squares = np.square(self.vectors.astype(np.float64)).sum(axis=1)
        self.square = np.maximum.reduceat(self.squares, cuts)
        self.low, self.high = (f.reduceat(self.pivots, cuts, axis=0) for f in (np.minimum, np.maximum))
        self.parts = [slice(a, a + _TILE) for a in cuts]
        self.step, self.whole = 1.0, np.zeros((0, len(ids)), np.int16)

    def whole_steps(self, query_pivots: np.ndarray) -> np.ndarray:
        """The queries' distances in whole steps, a row for each pivot; the candidates' are kept beside them."""
        self.step = max(self.pivots.max(initial=0), query_pivots.max(initial=0)) / _STEPS or 1.0
        self.whole, asked = (np.ascontiguousarray(np.floor(x / self.step).astype(np.int16).T) for x in (self.pivots, query_pivots))
        return asked

    def bounds(self, squares: np.ndarray, query_pivots: np.ndarray) -> np.ndarray:
        """(queries, tiles): no inner product with a tile's candidates is above. squares: of the queries' lengths."""
        apart = np.zeros((len(query_pivots), len(self.parts)))
        for p in range(query_pivots.shape[1]):
            d = query_pivots[:, p, None]
            np.maximum(apart, np.maximum(self.low[:, p] - d, d - self.high[:, p]), out=apart)
        return _above(squares[:, None] + self.square, apart)

    def own_bounds(self, part: slice, squares: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """(queries, candidates of a tile): the same for each candidate, by all pivots. Rounding down to steps widens a bound by a step at most."""
        out = np.empty((len(squares), len(self.ids[part])))
        for a in range(0, len(out), _AT_ONCE):
            some = slice(a, min(a + _AT_ONCE, len(out)))
            apart, gap = (np.zeros((some.stop - a, out.shape[1]), np.int16) for _ in range(2))
            for own, theirs in zip(asked[:, some], self.whole[:, part]):
                np.subtract(own[:, None], theirs, out=gap)
                np.abs(gap, out=gap)
                np.maximum(apart, gap, out=apart)
            out[some] = _above(squares[some, None] + self.squares[part], np.maximum(apart - 1.0, 0.0) * self.step)
        return out


def _above(both: np.ndarray, apart: np.ndarray) -> np.ndarray:
    return (both - np.square(apart)) / 2 + 1 + 1e-9 * both


def best(query_ids: np.ndarray, queries: np.ndarray, query_pivots: np.ndarray, floor: np.ndarray, tiles: Tiles, k: int, plain: bool):
    """For each query the (ids, scores) of its k best in a block, as far as they reach its floor, and how many were evaluated."""
    squares = np.square(queries.astype(np.float64)).sum(axis=1)
    bounds, asked = tiles.bounds(squares, query_pivots), tiles.whole_steps(query_pivots)
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = np.zeros(0, np.int64)
    found = [(none, none)] * len(queries)
    limit, evaluated = floor.copy(), np.zeros(len(queries), np.int64)  # limit: the k-th score so far
    for turn in range(len(tiles.parts)):
        tile = order[:, turn]
        going = np.flatnonzero(bounds[np.arange(len(queries)), tile] >= limit)
        if not len(going):
            break
        going = going[np.argsort(tile[going], kind="stable")]
        for group in np.split(going, np.flatnonzero(np.diff(tile[going])) + 1):
            part = tiles.parts[tile[group[0]]]
            ids = tiles.ids[part]
            left = (tiles.own_bounds(part, squares[group], asked[:, group]) >= limit[group, None]) & (ids != query_ids[group, None])
            evaluated[group] += left.sum(axis=1)
            some, any_ = left.any(axis=0), left.any(axis=1)
            if not any_.any():
                continue
            group, ids, left = group[any_], ids[some], left[any_][:, some]
            scores = _products(tiles.vectors[part][some], queries[group], plain)
            take = left & (scores >= limit[group, None])
            for q, row, kept in zip(group[take.any(axis=1)], scores[take.any(axis=1)], take[take.any(axis=1)]):
                new_ids, new = ids[kept], row[kept]
                if len(new) > 4 * k:  # those below the k-th of the tile are out
                    good = new >= np.partition(new, -k)[-k]
                    new_ids, new = new_ids[good], new[good]
                new_ids, new = np.concatenate([found[q][0], new_ids]), np.concatenate([found[q][1], new])
                first = np.lexsort((new_ids, -new))[:k]
                found[q] = new_ids[first], new[first]
                if len(first) == k:
                    limit[q] = max(limit[q], found[q][1][-1])
    return found, evaluated


def lists(rows: DataFrame, query: Column, k: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, id, score, evaluated): each block's best of each query; a row with null id tells how many candidates were evaluated."""
    taken = rows.where(usable(id_col, vector_col)).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    facts = taken.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("asks"), F.col("id"))).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(facts.width or 0, 0)
    sample_ids, sample = _sample(taken, width)
    chosen = _pivots(sample)

    def measure(batches):
        for batch in batches:
            vectors, asks = _matrix(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            table = _distances(vectors, chosen)
            floor = np.full(len(table), _LEAST)
            floor[asks] = floors(batch.column(0).to_numpy()[asks], vectors[asks], sample_ids, sample, k)
            offsets = np.arange(0, table.size + 1, max(table.shape[1], 1), dtype=np.int32) if table.size else np.zeros(len(table) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, table.ravel()), pa.array(floor)], ["id", "v", "asks", "p", "floor"])

    known = C.store(taken.mapInArrow(measure, "id bigint, v array<bigint>, asks boolean, p array<double>, floor bigint"), "pivots")
    n_c, n_q = max(1, -(-facts.n // CANDIDATES)), max(1, -(-facts.q // QUERIES))
    spread = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    asks = known.where("asks").groupBy("id").agg(F.min(F.struct("v", "p", "floor")).alias("x")).select("id", "x.v", "x.p", "x.floor")
    left = asks.select("*", C.salt("id", into=n_q).alias("qb"), spread(n_c, "cb"))
    right = known.select(F.col("id").alias("candidate"), F.col("v").alias("cv"), F.col("p").alias("cp"), C.salt("id", "v", into=n_c).alias("cb"), spread(n_q, "qb"))

    def block(_key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if queries.num_rows and candidates.num_rows:
            ids = candidates.column("candidate").to_numpy()
            vectors, pivots = _matrix(candidates.column("cv"), width), _matrix(candidates.column("cp"), len(chosen))
            asked, asked_pivots = _matrix(queries.column("v"), width), _matrix(queries.column("p"), len(chosen))
            plain = _exact(vectors, asked)
            query_ids = queries.column("id").to_numpy()
            tiles = Tiles(ids, vectors.astype(np.float64) if plain else vectors, pivots)
            found, evaluated = best(query_ids, asked, asked_pivots, queries.column("floor").to_numpy(), tiles, k, plain)
            for q, (found_ids, scores), n in zip(query_ids, found, evaluated):
                for column, values in zip(out, (np.full(len(found_ids), q, np.int64), found_ids, scores, np.full(len(found_ids), 0, np.int64))):
                    column.append(values)
            told = [query_ids, np.zeros(len(query_ids), np.int64), np.zeros(len(query_ids), np.int64), evaluated]
            out = [[*column, x] for column, x in zip(out, told)]
        parts = [np.concatenate(x) for x in out]
        null = np.zeros(len(parts[0]), bool)
        if queries.num_rows and candidates.num_rows:
            null[len(null) - queries.num_rows :] = True
        return pa.Table.from_arrays([pa.array(parts[0]), pa.array(parts[1], mask=null), pa.array(parts[2]), pa.array(parts[3])], ["query_id", "id", "score", "evaluated"])

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(block, "query_id bigint, id bigint, score bigint, evaluated bigint")


def search(rows: DataFrame, query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row where `query` holds, its k best among the others."""
    found = lists(rows, query, k, scale, id_col, vector_col).where("id IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", rank.alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)


def evaluated(rows: DataFrame, query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, evaluated): how many candidates were scored for each query; the bounds have ruled out the others."""
    return lists(rows, query, k, scale, id_col, vector_col).groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return search(C.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
