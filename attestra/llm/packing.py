"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

What is packed only depends on the lengths, so the plan is made on their histogram, which
has no more entries than the capacity has tokens. A bin is filled greedily, always by
the longest piece that fits; then its smallest piece is replaced by two unpacked ones
that together fill the widened gap better. The same filling is repeated as often as
the histogram has pieces for it, so a plan has few patterns however many pieces there are.

Spark counts the histogram, numbers the pieces of each length (in hashed buckets, so that
a hot length is spread) and gives each piece its place from the plan. Only the
histogram and the plan pass through the driver; both are bounded by the capacity.

Defined results: a null or empty text is its end token alone. Pieces are cut at the
capacity only; repeated rows are packed each on its own; an empty table gives no rows.
A null id is carried along.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm import common as C

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words that a Python worker remembers at most, and characters of text that it looks up at once.
MEMORY, CHUNK = 800_000, 2_000_000
#: Stands for the end of a word where the vocabulary says </w>; no word has it.
_MARK = "\0"
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def _letters(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The vocabulary for plain words, each with the mark at its end, and which ids end a word.

    Tokens are merged in the order of their ids, and single characters at an end come first.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=False)
    mark = _MARK.encode()
    ranks, ends = {}, np.zeros(max(vocabulary.values()) + 1, bool)
    for token, number in vocabulary.items():
        at_end = token.endswith("</w>") and len(token) > 4
        if set(token) <= byte_of.keys():
            ranks[bytes(map(byte_of.__getitem__, token[:-4] if at_end else token)) + (mark if at_end else b"")] = number
            ends[number] = at_end
    return tiktoken.Encoding("words", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={}), ends


def _plain(word: str) -> bool:
    """Letters that normalisation only lowers: one piece of the vocabulary's pattern."""
    return word.isalpha() and max(word) < "\u0180" and word.lower().isalpha()


class WordTokens:
    """Token ids of texts, word by word.

    The vocabulary's pattern never crosses ASCII white space and drops it, so a text's ids are
    those of its words in a row, and frequent words are encoded only once. New words of
    Latin letters, with punctuation behind them or not, are encoded many at a time; all others
    by the tokenizer.
    """

    def __init__(self, path: str):
        self.encode = functools.partial(_tokenizer(path).encode_batch, add_special_tokens=False)
        self.letters, self.ends = _letters(path)
        self.known: dict[bytes, bytes] = {}

    def _by_tokenizer(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encode(words)]

    def _by_letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.letters.encode_ordinary(_MARK.join(words).lower() + _MARK), "<u4") if words else np.zeros(0, "<u4")
        raw, cuts = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, words: list[bytes]) -> None:
        known, plain, others = self.known, [], []
        for w in words:
            text = w.decode("utf-8", "surrogatepass")
            core = text.rstrip(_PUNCTUATION)
            if core and _plain(core):
                plain.append((w, core, text[len(core) :]))
            else:
                others.append((w, text))
        tails = list({t for _, _, t in plain if t})
        tail_ids = {"": b""} | dict(zip(tails, self._by_tokenizer(tails)))
        for (w, _, tail), ids in zip(plain, self._by_letters([c for _, c, _ in plain])):
            known[w] = ids + tail_ids[tail]
        known.update(zip([w for w, _ in others], self._by_tokenizer([t for _, t in others])))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [x.encode("utf-8", "surrogatepass").split() for x in texts]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        self._learn([w for w in new if w not in known])
        return [b"".join(map(known.__getitem__, words)) for words in split]


@functools.cache
def _words(path: str) -> WordTokens:
    return WordTokens(path)


def _batches(column: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of bounded size."""
    run, size = [], 0
    for x in column:
        text = x.as_py() or ""
        run.append(text)
        size += len(text)
        if size > CHUNK:
            yield run
            run, size = [], 0
    yield run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str = VOCABULARY, end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each text's ids and its end token."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        words = _words(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            row = 0
            for texts in _batches(batch.column(1)):
                for ids in words.ids(texts):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (row, k, k * capacity, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Plan:
    """Slots in the order of the pieces, by length and then by number.

    Slot k holds the pieces from first[k] on: each of `bins` sequences from sequence[k] on gets one
    in turn, and each round stands one length further from offset[k].
    """

    first: np.ndarray
    bins: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    sequences: int

    def place(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.first, index, "right") - 1
        turn, which = np.divmod(index - self.first[k], self.bins[k])
        return self.sequence[k] + which, self.offset[k] + turn * self.length[k]


def _fill(left: np.ndarray, capacity: int) -> list[int]:
    """The lengths of one bin, by best-two-fit over what is left of each length. Doesn't change left."""
    left = left.copy()
    lengths = np.arange(len(left))
    chosen: list[int] = []
    gap = capacity
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        chosen.append(int(fits[-1]))
        left[chosen[-1]] -= 1
        gap -= chosen[-1]
    if gap and len(chosen) > 1:
        smallest = chosen[-1]
        gap += smallest
        # below[x]: the longest length up to x of which any are left
        below = np.maximum.accumulate(np.where(left[: gap + 1] > 0, lengths[: gap + 1], 0))
        one = np.flatnonzero(left[: gap + 1])
        two = below[gap - one]
        alone = (two == one) & (left[one] < 2)
        two[alone] = below[one[alone] - 1]
        total = np.where(two > 0, one + two, 0)
        if len(one) and total.max() > smallest:
            k = int(total.argmax())
            chosen[-1:] = [int(one[k]), int(two[k])]
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    start = np.cumsum(left) - left  # index of the first piece of each length
    slots, sequences = [], 0
    while left.any():
        chosen = sorted(_fill(left, capacity), reverse=True)
        need = dict.fromkeys(chosen, 0)
        for n in chosen:
            need[n] += 1
        bins = min(int(left[n]) // k for n, k in need.items())
        offset = 0
        for n, k in need.items():
            slots.append((int(start[n]), bins, sequences, offset, n))
            start[n] += k * bins
            left[n] -= k * bins
            offset += n * k
        sequences += bins
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences)


def pack(parts: DataFrame, keys: list[str], capacity: int = 2048) -> DataFrame:
    """parts (stored, with a column length) and sequence_id and offset for each row.

    keys: columns that tell rows apart; rows that agree in all of them are interchangeable.
    """
    spark, names = parts.sparkSession, parts.columns
    buckets = C.shuffle_width(spark)
    found = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    p = plan(found, capacity)
    firsts = np.zeros(capacity + 1, np.int64)
    firsts[1:] = np.cumsum([found.get(n, 0) for n in range(capacity)])

    rows = parts.withColumn("_bucket", C.salt(*keys, into=buckets))
    counts = rows.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "_bucket", (F.sum("n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_before"))
    numbered = rows.withColumn("_number", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*keys)))
    numbered = numbered.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_number") - 1).select(*names, "_rank")

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = p.place(firsts[length] + rank)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return numbered.mapInArrow(run, f"{ddl}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str = VOCABULARY, end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    parts = C.store(pieces(docs, id_col, text_col, capacity, path, end), "pieces")
    return pack(parts, ["id", "piece", "ids_crc32"], capacity).withColumnRenamed("id", id_col)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return packed(C.read(spark, sf_dir, "documents"))
