"""Byte-level BPE of whole texts, with content-defined chunks that are encoded once.

A rolling hash of the last bytes cuts texts into chunks, so passages that documents
share give the same chunks wherever they stand. Spark counts the chunks by their hash; those
that recur are brought together, encoded once each, and given to the documents that
hold them. The others are encoded where they stand.

Chunks are cut anywhere, so tokens across a cut are unknown to either side. A chunk's
encoding therefore keeps its ids only between its first and its last sure boundary, where a
piece of the tokenizer's pattern must begin whatever stands around it: a blank between two
other characters, or the place where letters, digits and other signs of any script meet. What lies
between two chunks' sure boundaries is joined and encoded anew; a chunk without one is
joined whole, so the join grows until both its ends agree with its neighbours.

Which chunks recur is told to the tasks by a Bloom filter of bounded size. A chunk that it
takes for a recurring one in error is only encoded elsewhere; a full filter costs
shuffles, never results. Chunks of more than a share of all recurring ones are dealt out
by salts; the list of those, at most 4 * shuffle partitions, is broadcast.

Pieces of any length, such as millions of blanks or of letters in a row, are encoded in nearly
linear time.

Defined results: a null text is an empty one, without ids. Repeated rows are encoded
each in its own row. Other columns don't matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The same vocabulary as the tokenizers library reads it, for very long pieces.
WHOLE = public_tokenizers.path("byte_bpe_50k.json")
#: Added by the tokenizer's own file, beside the ranks.
SPECIAL = {"<|endoftext|>": 50256}
#: A chunk has 2**CUT_BITS bytes on average; the rolling hash sees WINDOW bytes.
CUT_BITS, WINDOW = 10, 16
#: The least bytes of a chunk, lest periodic texts fall to pieces.
LEAST = 64
#: Most bits of the filter of recurring chunks, and how many stand for each.
FILTER_BITS, PROBES = 1 << 28, 4
#: A piece of so many characters goes to the encoder that is made for long ones.
_LONG = 400
_LONG_PIECE = regex.compile(rf"\p{{L}}{{{_LONG},}}|\p{{N}}{{{_LONG},}}|\s{{{_LONG},}}|[^\s\p{{L}}\p{{N}}]{{{_LONG},}}")
#: Characters that some regex engines take for white space, and signs that may join letters: contractions, the special token.
_UNSURE = r"\s\x1c-\x1f\x85\u180e'|"
_BOUNDARY = rf"(?<=[^{_UNSURE}])(?= [^{_UNSURE}])|(?<=\p{{L}})(?=[^{_UNSURE}\p{{L}}])|(?<=\p{{N}})(?=[^{_UNSURE}\p{{N}}])|(?<=[^{_UNSURE}\p{{L}}\p{{N}}])(?=[\p{{L}}\p{{N}}])"
_FIRST, _LAST = regex.compile(_BOUNDARY), regex.compile(_BOUNDARY, regex.REVERSE)
_MULTIPLIER = np.uint32(0x9E3779B1)
_BLANK = 0x20


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.cache
def _token_bytes(path: str) -> list[bytes]:
    e = _encoding(path)
    known = dict(zip(range(e.n_vocab), [b""] * e.n_vocab))
    known.update({e.encode_single_token(t): t for t in e.token_byte_values()})
    known.update({i: s.encode() for s, i in SPECIAL.items()})
    return [known[i] for i in range(e.n_vocab)]


@functools.cache
def _whole(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _encode(path: str, data: bytes) -> list[int]:
    if not data:
        return []
    text = data.decode("utf-8", "surrogatepass")
    if len(data) > _LONG:
        words = data.split()
        letters = sum(map(len, words))
        if (max(map(len, words), default=0) >= _LONG or len(data) - letters - len(words) >= _LONG - 1) and _LONG_PIECE.search(text):
            return _whole(WHOLE).encode(text, add_special_tokens=False).ids
    return _encoding(path).encode(text, allowed_special="all", disallowed_special=())


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, by content alone; the last is the end of data. Never inside a character."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    rolled = np.zeros(n - WINDOW + 1, np.uint32)
    for k in range(WINDOW):
        rolled *= _MULTIPLIER
        rolled += b[k : n - WINDOW + 1 + k] + np.uint32(1)
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x85EBCA6B)
    ends = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    ends = ends[(ends < n)]
    ends = ends[(b[ends] & 0xC0) != 0x80]
    if len(ends) and np.diff(ends, prepend=0).min() < LEAST:
        kept, k = [], int(np.searchsorted(ends, LEAST))
        while k < len(ends):
            kept.append(int(ends[k]))
            k = int(np.searchsorted(ends, kept[-1] + LEAST))
        return [*kept, n]
    return [*ends.tolist(), n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def chunk_key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _sure(chunk: bytes) -> tuple[int, int]:
    """The first and last sure boundary of a chunk, or its length and 0 if it has none.

    Blanks between printable ASCII characters are found first; only a chunk without any is searched for others.
    """
    b = np.frombuffer(chunk, np.uint8)
    if len(b) < 2:
        return len(b), 0
    plain = (b > _BLANK) & (b < 0x7F)
    at = np.flatnonzero((b[1:-1] == _BLANK) & plain[:-2] & plain[2:]) + 1
    if len(at):
        return int(at[0]), int(at[-1])
    text = chunk.decode("utf-8", "surrogatepass")
    first = _FIRST.search(text)
    if not first:
        return len(b), 0
    size = lambda x: len(x.encode("utf-8", "surrogatepass"))
    return size(text[: first.start()]), len(b) - size(text[_LAST.search(text).start() :])


def encode_chunk(path: str, chunk: bytes) -> tuple[int, int, bytes]:
    """(first sure boundary, last one, the ids between them as uint16)."""
    a, b = _sure(chunk)
    return a, b, np.array(_encode(path, chunk[a:b]), "<u2").tobytes() if a < b else b""


def assemble(path: str, parts: list[bytes], known: dict[int, tuple[int, int, bytes]]) -> np.ndarray:
    """A text's ids from its chunks: those in known by number, the others encoded here, and the joins repaired."""
    out: list[np.ndarray] = []
    join: list[bytes] = []
    for k, chunk in enumerate(parts):
        a, b, ids = known[k] if k in known else encode_chunk(path, chunk)
        if a > b:  # no sure boundary: the join goes on
            join.append(chunk)
            continue
        out.append(np.array(_encode(path, b"".join([*join, chunk[:a]])), np.uint32))
        out.append(np.frombuffer(ids, "<u2"))
        join = [chunk[b:]]
    out.append(np.array(_encode(path, b"".join(join)), np.uint32))
    return np.concatenate(out).astype("<u4")


def decode(path: str, ids: np.ndarray) -> str:
    known = _token_bytes(path)
    return b"".join([known[i] for i in ids.tolist()]).decode("utf-8", "replace")


# The filter ----------------------------------------------------------------


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of 16-byte keys (n, 2) of uint64: (n, PROBES)."""
    k = np.arange(PROBES, dtype=np.uint64)
    return (keys[:, :1] + k * (keys[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def _as_pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _filter(recurring: DataFrame) -> np.ndarray:
    """A Bloom filter of the recurring keys, its words set on the executors; at most FILTER_BITS."""
    n = recurring.count()
    bits = 1 << 10
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2

    def run(batches):
        for batch in batches:
            p = np.unique(_probes(_as_pairs(batch.column(0).to_pylist()), bits)) if batch.num_rows else np.zeros(0, np.uint64)
            words = p >> np.uint64(6)
            values = np.uint64(1) << (p & np.uint64(63))
            starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
            merged = np.bitwise_or.reduceat(values, starts) if len(starts) else values
            yield pa.RecordBatch.from_arrays([pa.array(words[starts].astype(np.int64)), pa.array(merged.view(np.int64))], ["word", "value"])

    set_words = recurring.select("key").mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value"))
    out = np.zeros(bits // 64, np.uint64)
    rows = set_words.toArrow()  # at most FILTER_BITS / 64 rows
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def _held(words: np.ndarray, keys: list[bytes]) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    p = _probes(_as_pairs(keys), 64 * len(words))
    return (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).all(axis=1)


# The job -------------------------------------------------------------------


def _bytes(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def recurring_chunks(rows: DataFrame) -> DataFrame:
    """(key, n) of the chunks that stand more than once in the column text."""

    def run(batches):
        for batch in batches:
            keys = [chunk_key(c) for x in batch.column(0) for c in chunks(_bytes(x))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    return rows.select("text").mapInArrow(run, "key binary").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def encoded_once(rows: DataFrame, words, path: str) -> DataFrame:
    """(key, first, last, ids) of the chunks that the filter holds, each encoded in one place."""

    def found(batches):
        for batch in batches:
            out: dict[bytes, bytes] = {}  # repeats within the batch leave it once
            for x in batch.column(0):
                parts = chunks(_bytes(x))
                keys = [chunk_key(c) for c in parts]
                out.update((k, c) for k, c, held in zip(keys, parts, _held(words.value, keys)) if held)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["key", "chunk"])

    def encode(batches):
        for batch in batches:
            done = [encode_chunk(path, x.as_py()) for x in batch.column(1)]
            a, b, ids = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(ids, pa.binary())], ["key", "first", "last", "ids"])

    once = rows.select("text").mapInArrow(found, "key binary, chunk binary").groupBy("key").agg(F.first("chunk").alias("chunk"))
    return once.mapInArrow(encode, "key binary, first int, last int, ids binary")


def encode(docs: DataFrame, digest, schema: str, text_col: str = "text", id_col: str = "doc_id", path: str = RANKS) -> DataFrame:
    """A row for each row of docs: its id and what `digest` makes of (path, ids as uint32).

    digest returns a tuple of the columns in `schema`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out_type = [f.dataType for f in _fields(spark, schema)]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(t) for t in out_type]
    recurring = C.store(recurring_chunks(rows), "recurring")
    words = spark.sparkContext.broadcast(_filter(recurring))
    shared = C.store(encoded_once(rows, words, path), "chunks")

    def first_pass(batches):
        """Texts without shared chunks are done; the others wait, compressed, under keys of their own."""
        number = TaskContext.get().partitionId() << 40
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            done, waiting, held_keys, numbers = [], [], [], []
            for x in batch.column(1):
                data = _bytes(x)
                parts = chunks(data)
                keys = [chunk_key(c) for c in parts]
                held = [k for k, h in zip(keys, _held(words.value, keys)) if h]
                done.append(None if held else digest(path, assemble(path, parts, {})))
                waiting.append(squeeze.compress(data) if held else None)
                held_keys.append(list(dict.fromkeys(held)) if held else None)
                numbers.append(number)
                number += 1
            columns = [pa.array([d and d[k] for d in done], t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array(waiting, pa.binary()), pa.array(held_keys, pa.list_(pa.binary())), *columns], ["id", "number", "text", "held", *names]
            )

    names = [f.name for f in _fields(spark, schema)]
    passed = C.store(rows.mapInArrow(first_pass, f"id {kind}, number bigint, text binary, held array<binary>, {schema}"), "first")
    waiting = passed.where(F.col("text").isNotNull())
    asked = waiting.select("number", F.explode("held").alias("key"))
    given = C.salted_join(asked, shared, "key", "number", recurring).groupBy("number").agg(F.collect_list(F.struct("key", "first", "last", "ids")).alias("known"))
    ready = waiting.select("id", "number", "text").join(given, "number", "left").select("id", "text", "known")

    def second_pass(batches):
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            done = []
            for text, known in zip(batch.column(1), batch.column(2)):
                parts = chunks(open_up.decompress(text.as_py()))
                by_key = {k["key"]: (k["first"], k["last"], k["ids"]) for k in known.as_py() or ()}
                numbered = {n: by_key[key] for n, key in enumerate(map(chunk_key, parts)) if key in by_key}
                done.append(digest(path, assemble(path, parts, numbered)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([d[k] for d in done], t) for k, t in enumerate(arrow)]], ["id", *names])

    finished = passed.where(F.col("text").isNull()).select("id", *names)
    return finished.unionByName(ready.mapInArrow(second_pass, f"id {kind}, {schema}")).withColumnRenamed("id", id_col)


def _fields(spark, schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fields


def with_ids(path: str, ids: np.ndarray) -> tuple:
    """Digest that keeps the ids themselves."""
    return (ids.astype(np.int32).tolist(),)


def hashes(path: str, ids: np.ndarray) -> tuple:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(path, ids).encode()).hexdigest()


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(C.read(spark, sf_dir, "documents"), hashes, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
