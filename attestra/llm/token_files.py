"""Token ids in Parquet: sorted files with delta or dictionary encoded lists, made for selective reads.

Texts are dealt by ranges of their id, encoded where they land, and written in ascending order of id by
Spark's own Parquet writer, so a lost task is written anew. A row is a document: its id, the part
of the table that it stands in, `start`, the number of ids before it in that part, `n_tokens` and the list `tokens`.
Ids of documents before a part are told by the other parts' totals, which `parts` reads from the
small columns alone; a part is a task of the writer, so that table has no more rows than the
writer had tasks.

Layout: row groups of `row_group` bytes and pages of `page` bytes, both with least and
greatest values of each column and an index of the pages. Columns are dictionary encoded or,
with dictionary=False, as deltas (numbers packed by blocks); tokens and the other columns may differ in that.
A reader of metadata touches the small columns only; a reader of some ids or of a range of
tokens skips row groups and pages by their statistics (`by_ids`, `by_tokens`).

Defined results: a null or empty text is its end token alone. Rows with a null id come first; repeated
ids stand beside each other in the order of a hash of their texts, equal texts in any order. An empty table is a table
without rows. Other columns aren't written.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe
from attestra.llm import common as C

#: Ends each document.
END = 2
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Characters of text whose ids a task holds at once.
_AT_ONCE = 4_000_000
COLUMNS = ["doc_id", "part", "start", "n_tokens", "tokens"]


def ids_of(path: str, text: str, end: int) -> np.ndarray:
    """A text's ids and the end id. Texts without very long words or gaps go straight to the encoder."""
    words = text.split() if len(text) >= bpe._LONG else []
    if words and max(map(len, words)) < bpe._LONG and len(text) - sum(map(len, words)) - len(words) < bpe._LONG - 1 or len(text) < bpe._LONG:
        found = bpe._encoding(path).encode_to_numpy(text, allowed_special="all", disallowed_special=())
    else:
        found = bpe._encode(path, text.encode("utf-8", "surrogatepass"))
    return np.append(found, end).astype(np.int32)


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) in ascending order of id over the partitions; a hot id is spread by its texts, a hot text by its place."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first("id"), F.asc("h"), F.asc("place")]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = bpe.RANKS, end: int = END) -> DataFrame:
    """The rows of the file, in its order."""
    rows = ordered(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, ids, size = 0, [], 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                ids.append(ids_of(path, text, end))
                size += len(text)
                if size < _AT_ONCE and k + 1 < batch.num_rows:
                    continue
                sizes = np.array([len(x) for x in ids], np.int64)
                before = start + np.cumsum(sizes) - sizes
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                columns = [batch.column(0).slice(held, len(ids)), pa.array(np.full(len(ids), part, np.int32)), pa.array(before), pa.array(sizes), tokens]
                yield pa.RecordBatch.from_arrays(columns, COLUMNS)
                start, held, ids, size = start + int(sizes.sum()), k + 1, [], 0

    return rows.mapInArrow(run, f"doc_id {kind}, part int, start bigint, n_tokens bigint, tokens array<int>")


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = bpe.RANKS, end: int = END,
          row_group: int = ROW_GROUP, page: int = PAGE, token_dictionary: bool = True) -> None:
    """Write the ids of docs to a new folder."""
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": 2000,
        # Documents ascend and starts grow, so deltas are short; tokens repeat.
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#part": "true", "parquet.enable.dictionary#tokens.list.element": str(token_dictionary).lower(),
    }
    encoded(docs, id_col, text_col, path, end).write.options(**{k: str(v) for k, v in options.items()}).parquet(folder)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, base): the ids before each part. Reads two small columns; one row for each task that wrote."""
    sums = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in sums:
        rows.append((r.part, before))
        before += r.n
    return spark.createDataFrame(rows, "part int, base bigint")


def read(spark: SparkSession, folder: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "tokens")) -> DataFrame:
    """Documents with their start among all ids; only the columns asked for are read, besides part."""
    stored = spark.read.parquet(folder)
    found = stored.join(F.broadcast(parts(spark, folder)), "part").withColumn("start", F.col("base") + F.col("start"))
    return found.select(*columns)


def by_ids(spark: SparkSession, folder: str, ids: Sequence[int]) -> DataFrame:
    """The documents of some ids: statistics of row groups and pages rule out where they can't be."""
    return spark.read.parquet(folder).where(F.col("doc_id").isin(*ids)).select("doc_id", "tokens")


def by_tokens(spark: SparkSession, folder: str, start: int, length: int) -> DataFrame:
    """(doc_id, start, tokens): ids start to start + length of the whole table, cut at both ends."""
    base = {r.part: r.base for r in parts(spark, folder).collect()}  # a row for each task that wrote
    order = sorted(base)
    inside = [p for p, after in zip(order, [*[base[q] for q in order[1:]], None]) if base[p] < start + length and (after is None or after > start)]
    if not inside or length <= 0:
        return spark.read.parquet(folder).where("false").select("doc_id", "start", "tokens")
    reach = F.lit(False)
    for p in inside:  # neighbours in order; each test names a part and plain columns, so it reaches the scan
        reach = reach | ((F.col("part") == p) & (F.col("start") < start + length - base[p]))
    shift = F.create_map(*[F.lit(x) for p in inside for x in (p, base[p])])
    found = spark.read.parquet(folder).where(reach).withColumn("start", F.element_at(shift, F.col("part")) + F.col("start"))
    found = found.where((F.col("start") + F.col("n_tokens") > start) & (F.col("start") < start + length))
    first, last = F.greatest(F.lit(start) - F.col("start"), F.lit(0)), F.least(F.lit(start + length) - F.col("start"), F.col("n_tokens"))
    return found.select("doc_id", (F.col("start") + first).alias("start"), F.slice("tokens", (first + 1).cast("int"), (last - first).cast("int")).alias("tokens"))


def checksums(found: DataFrame) -> DataFrame:
    """found with ids_crc32, of each document's ids as little-endian unsigned 32-bit integers, instead of tokens."""
    kept = [c for c in found.columns if c != "tokens"]

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("tokens"))
            values, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum(np.diff(lists.offsets.to_numpy()))
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(np.r_[0, ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*kept).schema)
    return found.mapInArrow(run, f"{ddl}, ids_crc32 bigint")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    folder = C.new_path(spark, "tokens")
    write(C.read(spark, sf_dir, "documents"), folder)
    return checksums(read(spark, folder))
