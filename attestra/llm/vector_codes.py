"""Product codes of vectors, with VA-file filtering of the codebooks' entries.

A vector is cut into equal parts, and each part is told by the number of the nearest entry of its
position's codebook. Codebooks start from the rows of least id and are refined by rounds: all parts
are assigned, then each entry becomes the mean of its parts.

Nearest entries are found as in a VA-file. Each coordinate of the entries is quantised to
`BITS` bits: entries are dealt by rank into cells, and a cell is known by its least and its
greatest value. Per query, a table of each coordinate's cells holds the least and the greatest squared
gap, and their sums by an entry's cells bound its distance from both sides. Only entries
whose lower bound doesn't exceed the least upper bound are refined, by exact whole-number distances.

A round is one scan over the stored whole-number vectors: tasks add up sums and counts of
each entry, and only those, bounded by codebooks times tasks, are shuffled. The codebooks
alone come to the driver, and their size doesn't depend on the number of rows.

Components are floor(scale * x) as whole numbers, held to the range of a long, and distances are exact,
also where they go beyond a long; the results are held to it.

Defined results: rows with a null vector, or a null or non-finite component, are dropped. The width
is that of the longest vector, rounded up to a multiple of the parts; shorter vectors
count as filled up with zeros. A null id is coded like any other but starts no entry; of repeated ids
the one with the least vector comes first. With fewer rows than entries, codebooks have
as many entries as rows; an empty table has empty codebooks. Equal entries are told apart by their
index, the least of which is taken. Null labels are one label. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C
from attestra.llm.topk import _matrix, scaled

#: Bits of an approximated coordinate, and queries bounded at once. Neither changes a result.
BITS, _AT_ONCE = 3, 4096
_LONG = np.iinfo(np.int64)


@dataclass
class Codebooks:
    """entries: (parts, entries, width of a part) whole numbers, as Python's where int64 could overflow."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


class Approximation:
    """The VA-file of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        cells = min(1 << BITS, max(n, 1))
        #: cell[e, j]: where entry e lies in coordinate j; low and high: (width, cells), the range of what lies there.
        self.cell = np.empty((n, width), np.int64)
        self.low, self.high = (np.zeros((width, cells), entries.dtype) for _ in range(2))
        for j in range(width):
            order = np.argsort(entries[:, j], kind="stable")
            self.cell[order, j] = np.arange(n) * cells // max(n, 1)
            for c in range(cells):
                held = entries[self.cell[:, j] == c, j]
                if len(held):
                    self.low[j, c], self.high[j, c] = held.min(), held.max()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, entries): no squared distance is below the first or above the second, by tables of each query's gaps."""
        least, most = (np.zeros((len(queries), len(self.entries)), queries.dtype) for _ in range(2))
        for j in range(queries.shape[1]):
            x = queries[:, j, None]
            under, over = self.low[j] - x, x - self.high[j]
            gap = np.maximum(np.maximum(under, over), 0)
            reach = np.maximum(np.abs(under), np.abs(over))  # to the far end of the cell
            least += (gap * gap)[:, self.cell[:, j]]
            most += (reach * reach)[:, self.cell[:, j]]
        return least, most

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each query's nearest entry, and how many entries were refined."""
        index = np.zeros(len(queries), np.int64)
        distance = np.zeros(len(queries), queries.dtype)
        refined = 0
        for a in range(0, len(queries), _AT_ONCE):
            some = queries[a : a + _AT_ONCE]
            least, most = self.bounds(some)
            q, e = np.nonzero(least <= most.min(axis=1)[:, None])
            refined += len(q)
            gaps = some[q] - self.entries[e]
            exact = (gaps * gaps).sum(axis=1)
            first = np.lexsort((e, exact, q)) if queries.dtype != object else np.array(sorted(range(len(q)), key=lambda k: (q[k], exact[k], e[k])), np.int64)
            first = first[np.flatnonzero(np.diff(q[first], prepend=-1))]
            index[a : a + _AT_ONCE], distance[a : a + _AT_ONCE] = e[first], exact[first]
        return index, distance, refined


def _fitting(largest: int, width: int) -> type:
    """int64 where squared distances fit, Python's numbers otherwise."""
    return np.int64 if largest < 1 << 62 and (2 * largest) ** 2 * max(width, 1) < 1 << 62 else object


def _assigned(vectors: np.ndarray, books: list[Approximation]) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, squared distances), a column for each part."""
    width = vectors.shape[1] // max(len(books), 1)
    found = [b.nearest(vectors[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1), sum(f[2] for f in found)


def _sums(rows: DataFrame, books: Codebooks, width: int, dtype: type) -> dict[tuple[int, int], tuple[list[int], int]]:
    """By (part, entry): the sum of its parts and their number."""
    parts, n, part = books.entries.shape

    def add(batches):
        seen = np.zeros((parts, n), np.int64)
        high, low = (np.zeros((parts, n, part), np.int64) for _ in range(2))  # value = high * 2**32 + low: sums of either keep within a long
        approximations = [Approximation(e) for e in books.entries]
        for batch in batches:
            plain = _matrix(batch.column(0), width)
            codes, _, _ = _assigned(plain.astype(dtype), approximations)
            for p in range(parts):
                own = plain[:, p * part : (p + 1) * part]
                np.add.at(seen[p], codes[:, p], 1)
                np.add.at(high[p], codes[:, p], own >> 32)
                np.add.at(low[p], codes[:, p], own & 0xFFFFFFFF)
        used = np.argwhere(seen)
        at = (used[:, 0], used[:, 1])
        listed = lambda x: pa.array(x[at].tolist(), pa.list_(pa.int64()))
        columns = [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(seen[at]), listed(high), listed(low)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "high", "low"])

    found = rows.select("v").mapInArrow(add, "part int, entry int, n bigint, high array<bigint>, low array<bigint>")
    each = found.select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("place", "x"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    sums = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), whole("x.high").alias("high"), whole("x.low").alias("low"))
    out: dict[tuple[int, int], tuple[list[int], int]] = {}
    for r in sums.collect():  # at most the codebooks' components
        out.setdefault((r.part, r.entry), ([0] * part, r.n))[0][r.place] = (int(r.high) << 32) + int(r.low)
    return out


def _first(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """Codebooks from the rows of the least ids: (parts, entries, width of a part)."""
    least = rows.where(F.col("id").isNotNull()).orderBy("id", "v").select("v").limit(entries).collect()
    out = np.zeros((len(least), width), object)
    for row, r in zip(out, least):
        row[: len(r.v)] = r.v
    return out.reshape(len(least), parts, width // parts).transpose(1, 0, 2)


def fit(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[Codebooks, int, type]:
    """Codebooks over all rows (id, v), the vectors' width with its filling, and the type that distances need."""
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    width = -(-max(facts.width or 0, 0) // parts) * parts
    dtype = _fitting(max(facts.high or 0, -(facts.low or 0), 0), width)
    books = Codebooks(_first(rows, parts, entries, width).astype(dtype))
    for _ in range(rounds if books.entries.size else 0):
        moved = books.entries.copy()
        for (p, e), (total, n) in _sums(rows, books, width, dtype).items():
            moved[p, e] = [x // n for x in total]  # // goes down for all signs
        books = Codebooks(moved)
    return books, width, dtype


def coded(rows: DataFrame, books: Codebooks, width: int, dtype: type) -> DataFrame:
    """rows (id, label, v) as (id, label, code, error, refined): refined entries are those that bounds didn't rule out."""
    kept = [c for c in rows.columns if c != "v"]

    def run(batches):
        approximations = [Approximation(e) for e in books.entries]
        for batch in batches:
            vectors = _matrix(batch.column(batch.schema.get_field_index("v")), width).astype(dtype)
            codes, errors, refined = [], [], []
            for a in range(0, len(vectors), _AT_ONCE):
                some = vectors[a : a + _AT_ONCE]
                if not books.entries.size:
                    found, error, n = np.zeros((len(some), 0), np.int64), np.zeros((len(some), 1), np.int64), 0
                else:
                    found, error, n = _assigned(some, approximations)
                codes += [bytes(c).hex() for c in found.astype(np.uint8)]
                errors += [min(int(e), _LONG.max) for e in error.sum(axis=1)]
                refined += [n] + [0] * (len(some) - 1) if len(some) else []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(refined, pa.int64())], [*kept, "code", "error", "refined"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.mapInArrow(run, f"{ddl}, code string, error bigint, refined bigint")


def vectors(docs: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, v): the rows that take part, stored as whole numbers."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    taken = docs.where(_finite(vector_col)).select(F.col(id_col).alias("id"), label.alias("label"), scaled(F.col(vector_col), scale).alias("v"))
    return C.store(taken, "vectors")


def _finite(vector_col: str):
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector_col).isNotNull() & finite


def compress(docs: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """((id, code, error, label_error, refined), codebooks) for each row that takes part.

    A label's error is summed before anything meets by label; labels of more than a share of the rows are dealt out by salts.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors(docs, scale, id_col, vector_col, label_col)
    books, width, dtype = fit(rows, parts, entries, rounds)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    done = C.store(coded(rows, books, width, dtype).withColumn("key", key), "coded")
    most = F.lit(_LONG.max).cast("decimal(38,0)")
    sums = done.groupBy("key").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(28,0)")), most).cast("long").alias("label_error"))
    out = C.salted_join(done, sums.select("key", "label_error"), "key", "id, code", sums.select("key", "n"))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", "refined"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books = compress(C.read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same by comparing every part with every entry, a pair of tables for each round."""
    steps = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
least AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL QUALIFY e < {entries}),
book0 AS MATERIALIZED (SELECT p, e, x AS y FROM least JOIN cut USING (r))"""]  # fmt: skip
    nearest = "SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN book{k} USING (p)) GROUP BY r, p, x"
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({nearest.format(k=k)})")
        steps.append(f"""mean{k} AS MATERIALIZED (SELECT p, e, list(m ORDER BY j) AS y FROM (
  SELECT p, e, j, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM near{k}) GROUP BY p, e, j) GROUP BY p, e)""")  # fmt: skip
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"last AS MATERIALIZED ({nearest.format(k=rounds)})")
    steps.append("coded AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY r)")
    steps.append("said AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book%d)" % rounds)
    end = "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), said"
    return ",\n".join(steps) + "\n" + end


ORACLE = _oracle()
