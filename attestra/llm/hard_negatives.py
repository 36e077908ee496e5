"""Hard negatives by branch and bound over ball trees, one tree for each block of rows.

An anchor's positives are the rows of its own label with the highest inner products. Of each positive, the
hard negatives are the best rows of other labels whose score lies in a window below the
positive's: `low` to `high` hundredths of it.

Rows are dealt to the nearest of a bounded sample of pivots, and a pivot's rows to as many
blocks of bounded size as they need, so any hot vector is spread. Each block's rows become one ball
tree, built once and stored: nodes halve their rows along a far pair of them and keep centre, radius
and the range of labels. For an anchor q, a node's inner products lie within q.centre - |q| radius and
q.centre + |q| radius. The pivots' balls are bounded in the same way on the driver's small table, and an anchor
goes only to blocks that may hold something for it.

In a block, all anchors that came go down the tree together, nearer children first. A
node is left by the anchors for which it lies wholly above or below their score windows, strictly
beneath their k-th score so far, or holds no label that they want. The rows of leaves are scored
exactly, and the blocks' lists are merged by rank. Positives are found first, with the k-th of a
sample as the least score to look for; the windows that they leave are searched by a second pass over the same trees.

Components are floor(scale * x) as whole numbers and scores exact, both held to the range of a
long; bounds are widened by more than their rounding error.

Defined results: rows with a null label, id or vector, or a null or non-finite component, take no
part; a shorter vector counts as filled up with zeros. Rows that share the anchor's id are neither its
positives nor its negatives; other repeated rows each count, and of an anchor id given more
than once the row with the least label and vector asks. A positive below zero has an empty window; one of
zero takes negatives of zero. Positives without negatives give no rows. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm import common as C
from attestra.llm.topk import _distances, _exact, _matrix, _pivots, _sample, scaled, usable

#: Rows of a block, anchors searched at once, rows of a leaf. None changes a result.
BLOCK, ANCHORS, LEAF = 8192, 2048, 64
_LONG = np.iinfo(np.int64)
_TREE = "block int, ids binary, labels binary, vectors binary, centres binary, radii binary, least binary, most binary"
_FOUND = "anchor bigint, target int, id bigint, score bigint, evaluated bigint"


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(queries, vectors): exact inner products, held to the range of a long."""
    if _exact(queries, vectors):
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return np.clip(queries.astype(object) @ vectors.astype(object).T, _LONG.min, _LONG.max).astype(np.int64)


def _halves(n: int) -> list[tuple[int, int, int]]:
    """(start, end, second child or 0) of a tree's nodes in preorder; the first child comes next."""
    out: list[tuple[int, int, int]] = []

    def grow(a: int, b: int) -> None:
        at = len(out)
        out.append((a, b, 0))
        if b - a > LEAF:
            grow(a, (a + b) // 2)
            out[at] = (a, b, len(out))
            grow((a + b) // 2, b)

    if n:
        grow(0, n)
    return out


@dataclass
class BallTree:
    """Rows in the order of the leaves; where nodes begin and end follows from the number of rows."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> BallTree:
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        nodes = _halves(len(ids))
        centres, radii = np.zeros((len(nodes), points.shape[1])), np.zeros(len(nodes))
        least, most = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for k, (a, b, second) in enumerate(nodes):
            own = points[order[a:b]]
            centres[k] = own.mean(axis=0)
            far = np.square(own - centres[k]).sum(axis=1)
            radii[k] = np.sqrt(far.max())
            least[k], most[k] = labels[order[a:b]].min(), labels[order[a:b]].max()
            if second:
                one = own[far.argmax()]
                other = own[np.square(own - one).sum(axis=1).argmax()]
                along = own @ (one - other)
                order[a:b] = order[a:b][np.argpartition(along, (b - a) // 2)]
        return cls(ids[order], labels[order], vectors[order], centres, radii, least, most)

    def columns(self) -> list[bytes]:
        return [x.tobytes() for x in (self.ids, self.labels, self.vectors, self.centres, self.radii, self.least, self.most)]

    @classmethod
    def read(cls, parts: list[bytes], width: int) -> BallTree:
        whole = lambda b: np.frombuffer(b, np.int64)
        ids, labels, vectors, centres, radii, least, most = parts
        return cls(whole(ids), whole(labels), whole(vectors).reshape(-1, width), np.frombuffer(centres).reshape(-1, width), np.frombuffer(radii), whole(least), whole(most))


@dataclass
class Search:
    """The k best of each of an anchor's targets (score windows), as far as a tree holds them.

    low, high: (anchors, targets), the windows; an empty one has low > high. other: whether rows of
    other labels are wanted, or those of the anchor's own.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    other: bool

    def __post_init__(self):
        n, targets = self.low.shape
        self.scores = np.full((n, targets, self.k), _LONG.min)
        self.found = np.full((n, targets, self.k), _LONG.max)
        self.filled = np.zeros((n, targets, self.k), bool)
        self.evaluated = np.zeros(n, np.int64)
        self.points = self.vectors.astype(np.float64)
        self.length = np.sqrt(np.square(self.points).sum(axis=1))
        self.open = self.low <= self.high

    def floor(self, who: np.ndarray) -> np.ndarray:
        """(who, targets): scores below can't be among the k best."""
        return np.where(self.filled[who, :, -1], np.maximum(self.low[who], self.scores[who, :, -1]), self.low[who])

    def reaching(self, tree: BallTree, node: int, who: np.ndarray) -> np.ndarray:
        """Those of the anchors for which the node may hold something."""
        middle, reach = self.points[who] @ tree.centres[node], self.length[who] * tree.radii[node]
        slack = 1 + 1e-9 * (np.abs(middle) + reach + self.length[who] * np.sqrt(np.square(tree.centres[node]).sum()))
        above, beneath = (middle + reach + slack)[:, None], (middle - reach - slack)[:, None]
        good = (self.open[who] & (above >= self.floor(who)) & (beneath <= self.high[who])).any(axis=1)
        if self.other:
            return who[good & ~((tree.least[node] == tree.most[node]) & (self.labels[who] == tree.least[node]))]
        return who[good & (self.labels[who] >= tree.least[node]) & (self.labels[who] <= tree.most[node])]

    def descend(self, tree: BallTree) -> None:
        nodes = _halves(len(tree.ids))
        waiting = [(0, np.arange(len(self.ids)))] if nodes else []
        while waiting:
            node, who = waiting.pop()
            who = self.reaching(tree, node, who)  # here, not when it was put off: k-th scores have risen since
            if not len(who):
                continue
            a, b, second = nodes[node]
            if not second:
                self.score(tree, a, b, who)
                continue
            nearer = self.points[who] @ (tree.centres[node + 1] - tree.centres[second]) >= 0
            for child, those in ((second, who[nearer]), (node + 1, who[nearer]), (node + 1, who[~nearer]), (second, who[~nearer])):
                if len(those):
                    waiting.append((child, those))

    def score(self, tree: BallTree, a: int, b: int, who: np.ndarray) -> None:
        """Exact scores of a leaf's rows, merged into the lists."""
        ids = tree.ids[a:b]
        same = tree.labels[a:b] == self.labels[who, None]
        wanted = (~same if self.other else same) & (ids != self.ids[who, None])
        self.evaluated[who] += wanted.sum(axis=1)
        scores = products(self.vectors[who], tree.vectors[a:b])
        for t in range(self.low.shape[1]):
            take = wanted & (scores >= self.floor(who)[:, t, None]) & (scores <= self.high[who, t, None])
            some = np.flatnonzero(take.any(axis=1))
            if not len(some):
                continue
            at, kept = who[some], take[some]
            all_scores = np.concatenate([self.scores[at, t], np.where(kept, scores[some], _LONG.min)], axis=1)
            all_ids = np.concatenate([self.found[at, t], np.where(kept, ids, _LONG.max)], axis=1)
            filled = np.concatenate([self.filled[at, t], kept], axis=1)
            # -score - 1 turns the order without overflow
            first = np.lexsort((all_ids, -all_scores - 1, ~filled), axis=-1)[:, : self.k]
            for held, values in ((self.scores, all_scores), (self.found, all_ids), (self.filled, filled)):
                held[at, t] = np.take_along_axis(values, first, axis=1)

    def rows(self) -> pa.Table:
        """Table of _FOUND: what was found, and a row with null id for each anchor that tells how much was scored."""
        q, t, k = np.nonzero(self.filled)
        n = len(self.ids)
        nothing = np.r_[np.zeros(len(q), bool), np.ones(n, bool)]
        columns = [np.r_[self.ids[q], self.ids], np.r_[t, np.zeros(n, np.int64)], np.r_[self.found[q, t, k], self.ids], np.r_[self.scores[q, t, k], np.zeros(n, np.int64)], np.r_[np.zeros(len(q), np.int64), self.evaluated]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k, mask=nothing if j in (2, 3) else None) for j, (c, k) in enumerate(zip(columns, kinds))], ["anchor", "target", "id", "score", "evaluated"])


@dataclass
class Cells:
    """The pivots' balls and blocks: a table whose size doesn't grow with the rows."""

    pivots: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = _distances(points, self.pivots)
        cell = apart.argmin(axis=1) if apart.shape[1] else np.zeros(len(points), np.int64)
        return cell, apart[np.arange(len(points)), cell] if apart.shape[1] else np.zeros(len(points))

    def reached(self, points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(points, cells): cells that may hold an inner product of low to high (points, targets) with the point."""
        length = np.sqrt(np.square(points).sum(axis=1))[:, None]
        middle, reach = points @ self.pivots.T, length * self.radii
        slack = 1 + 1e-9 * (np.abs(middle) + reach + length * np.sqrt(np.square(self.pivots).sum(axis=1)))
        out = np.zeros(middle.shape, bool)
        for t in range(low.shape[1]):
            out |= (low[:, t, None] <= high[:, t, None]) & (middle + reach + slack >= low[:, t, None]) & (middle - reach - slack <= high[:, t, None])
        return out


class Forest:
    """The rows of a table as stored ball trees, and searches among them."""

    def __init__(self, rows: DataFrame, anchor: Column, label: Column, scale: int, id_col: str, vector_col: str):
        taken = rows.where(usable(id_col, vector_col) & label.isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks")
        )
        taken = C.store(taken, "rows")
        facts = taken.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("asks"), F.col("id"))).alias("q"), F.max(F.size("v")).alias("width")).first()
        self.width = max(facts.width or 0, 0)
        self.turns = max(1, -(-facts.q // ANCHORS))
        _, sample = _sample(taken, self.width)
        pivots = _pivots(sample)[: max(1, -(-facts.n // 1024))]
        pivots = pivots if len(pivots) else np.zeros((1, self.width))
        self.cells = self._measure(taken, pivots)
        self.anchors = taken.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
        self.trees = C.store(self._trees(taken), "trees")
        seen = _sample(taken.select("id", F.concat(F.array("label"), F.col("v")).alias("v")), self.width + 1)
        self.sample = seen[0], seen[1][:, 0], seen[1][:, 1:]

    def _measure(self, taken: DataFrame, pivots: np.ndarray) -> Cells:
        cells, width = Cells(pivots, np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)), self.width

        def add(batches):
            n, far = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
            for batch in batches:
                cell, apart = cells.nearest(_matrix(batch.column(0), width).astype(np.float64))
                np.add.at(n, cell, 1)
                np.maximum.at(far, cell, apart)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(n), pa.array(far)], ["cell", "n", "far"])

        sums = taken.select("v").mapInArrow(add, "cell bigint, n bigint, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
        for r in sums.collect():  # a row for each pivot
            cells.blocks[r.cell], cells.radii[r.cell] = -(-r.n // BLOCK), r.far * (1 + 1e-9)
        cells.first = np.cumsum(cells.blocks) - cells.blocks
        return cells

    def _trees(self, taken: DataFrame) -> DataFrame:
        cells, width = self.cells, self.width

        def deal(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                cell, _ = cells.nearest(_matrix(batch.column(2), width).astype(np.float64))
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block = cells.first[cell] + (mixed + np.arange(len(ids)).astype(np.uint64)).astype(np.int64) % cells.blocks[cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32))], ["id", "label", "v", "block"])

        def grow(key, table):
            tree = BallTree.build(table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"), width))
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in tree.columns()]], [x.split()[0] for x in _TREE.split(", ")])

        dealt = taken.select("id", "label", "v").mapInArrow(deal, "id bigint, label bigint, v array<bigint>, block int")
        return dealt.groupBy("block").applyInArrow(grow, _TREE)

    def search(self, asked: DataFrame, k: int, other: bool) -> DataFrame:
        """(anchor, target, id, score, evaluated) by block for anchors (id, label, v, low, high); low and high are arrays."""
        cells, width = self.cells, self.width

        def send(batches):
            for batch in batches:
                low, high = (_windows(batch.column(c)) for c in (3, 4))
                reached = cells.reached(_matrix(batch.column(2), width).astype(np.float64), low, high)
                lists = [np.flatnonzero(r) for r in reached]
                ranges = [[{"a": int(cells.first[c]), "b": int(cells.first[c] + cells.blocks[c])} for c in x if cells.blocks[c]] for x in lists]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["id", "label", "v", "low", "high", "to"])

        kind = "id bigint, label bigint, v array<bigint>, low array<bigint>, high array<bigint>, to array<struct<a: int, b: int>>"
        sent = asked.select("id", "label", "v", "low", "high").mapInArrow(send, kind).select("*", F.explode("to").alias("r")).drop("to")
        sent = sent.select("id", "label", "v", "low", "high", C.salt("id", into=self.turns).alias("turn"), F.explode(F.expr("sequence(r.a, r.b - 1)")).alias("block"))
        trees = self.trees.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.turns - 1))).alias("turn"))

        def look(_key, asking: pa.Table, tree: pa.Table) -> pa.Table:
            low, high = (_windows(asking.column(c)) if asking.num_rows else np.zeros((0, 1), np.int64) for c in ("low", "high"))
            s = Search(asking.column("id").to_numpy(), asking.column("label").to_numpy(), _matrix(asking.column("v"), width) if asking.num_rows else np.zeros((0, width), np.int64), low, high, k, other)
            if asking.num_rows and tree.num_rows:
                s.descend(BallTree.read([tree.column(c)[0].as_py() for c in ("ids", "labels", "vectors", "centres", "radii", "least", "most")], width))
            return s.rows()

        return sent.groupBy("block", "turn").cogroup(trees.groupBy("block", "turn")).applyInArrow(look, _FOUND)


def _windows(column) -> np.ndarray:
    """Arrays of one length, as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(anchor, target, rank, id, score): the k best of each target over all blocks."""
    rank = F.row_number().over(W.partitionBy("anchor", "target").orderBy(F.desc("score"), "id"))
    return found.where("id IS NOT NULL").select("anchor", "target", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)


def positives(forest: Forest, k: int) -> DataFrame:
    """(anchor, rank, id, score) for the k best rows of each anchor's own label."""
    ids, labels, vectors = forest.sample
    width = forest.width

    def start(batches):
        """The least score worth looking for: the k-th of the anchor's label in the sample."""
        for batch in batches:
            own = _matrix(batch.column(2), width)
            scores = products(own, vectors)
            scores[(labels != batch.column(1).to_numpy()[:, None]) | (ids == batch.column(0).to_numpy()[:, None])] = _LONG.min
            low = np.partition(scores, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(own), _LONG.min)
            listed = lambda x: pa.array(x[:, None].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed(low), listed(np.full(len(low), _LONG.max))], ["id", "label", "v", "low", "high"])

    asked = forest.anchors.mapInArrow(start, "id bigint, label bigint, v array<bigint>, low array<bigint>, high array<bigint>")
    return _ranked(forest.search(asked, k, other=False), k).drop("target")


def mine(rows: DataFrame, anchor: Column, label: Column, positive: int = 5, negative: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module."""
    forest = Forest(rows, anchor, label, scale, id_col, vector_col)
    pairs = C.store(positives(forest, positive).withColumnsRenamed({"rank": "target", "id": "positive_id", "score": "positive_score"}), "positives")
    # The window of whole numbers n with low * p <= 100 * n <= high * p; an anchor's have one place each, empty ones included.
    exact = lambda share: F.col("positive_score").cast("decimal(20,0)") * share
    up, down = F.ceil(exact(low) / 100), F.floor(exact(high) / 100)
    fitted = lambda c: F.least(F.greatest(c, F.lit(_LONG.min).cast("decimal(38,0)")), F.lit(_LONG.max).cast("decimal(38,0)")).cast("long")
    windows = pairs.select("anchor", F.struct("target", fitted(up).alias("low"), fitted(down).alias("high")).alias("w")).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w.target", F.struct("w.low", "w.high")))).alias("w"))
    place = lambda c, none: F.transform(F.sequence(F.lit(1), F.lit(positive)), lambda t: F.coalesce(F.element_at("w", t)[c], F.lit(none)))
    asked = forest.anchors.join(windows, F.col("id") == F.col("anchor")).select("id", "label", "v", place("low", 1).alias("low"), place("high", 0).alias("high"))
    found = _ranked(forest.search(asked, negative, other=True), negative).select("anchor", (F.col("target") + 1).alias("target"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(pairs, ["anchor", "target"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def evaluated(rows: DataFrame, anchor: Column, label: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor, evaluated): how many rows of its label were scored to find each anchor's positives."""
    forest = Forest(rows, anchor, label, scale, id_col, vector_col)
    low = F.array(F.lit(int(_LONG.min))), F.array(F.lit(int(_LONG.max)))
    found = forest.search(forest.anchors.select("*", low[0].alias("low"), low[1].alias("high")), k, other=False)
    return found.groupBy("anchor").agg(F.sum("evaluated").alias("evaluated"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(C.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
