"""Language-model scores: a hashed maximum-entropy model with a softmax factored by classes.

Every text counts and every text is scored. Spark counts the training words by the words
themselves; texts travel in batches of bounded size that hold each of their words once, so a
word is looked up once for a batch. Words of more than a share of all tokens are looked up in a
short list, which is broadcast; no key of the other words is hot.

The model factors a word by a class and a class within it:
P(w | h) = P(a | h) P(b | a, h) P(w | a, b). Each of the first two is a softmax over CLASSES
over hashed features of the history: the previous word, the two previous ones, the one before
the last alone (a skip), the endings of both, and a bias. The first class goes by how a word
ends; words seen once or never are one of its values, and so is the end of a text; neither
has classes within it. The second goes by the word's hash. In the inner class words go by
their counts; the rare class also holds the unknown word. For
training, a word is rare if it is so without itself, so unseen words are learned from
words seen once.

A weight's row is a hash of feature and class in a table that grows with the training
tokens, from 2**18 rows to 2**21 (200 MB, what a task and the driver can hold). Training is by
gradient steps on the executors. Each round takes batches that no other round does; each task goes
over its own from the shared weights, in small steps scaled by the gradients so far; rows
that tasks moved are averaged by their squared gradients, so a row that one task alone has seen
keeps what it learned. Tasks are so many that what they send stays in proportion to the tokens.
Only weights pass through the driver.

Defined results: a null text is an empty one: its end alone. A null id counts as the empty
string for the split. Repeated rows count and are scored each on their own. Where no text
is for training, N and V are zero and all words are unknown. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Collection
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FOLDS, HELD_OUT = 7, 2
#: Characters of a batch; classes of a softmax (of the first: 0 the rare words, the last the end); softmaxes.
BATCH, CLASSES, LEVELS = 16_000_000, 24, 2
#: The table's rows as a power of two, and training tokens for each row between them.
MIN_BITS, MAX_BITS, TOKENS_A_ROW = 18, 21, 512
#: Tokens of a gradient step (at most 2**_PLACE); its scale; rounds; tokens of a training task for each row.
STEP, RATE, ROUNDS, TASK_TOKENS_A_ROW = 4096, 0.15, 2, 12
_PLACE = 20
#: Tokens of a slice of whole texts: what a task holds of a batch beside the batch itself.
SLICE = 1 << 18
#: Features of whole words come first and share three quarters of the table; endings and the bias share the rest.
WHOLE_WORDS = 3
#: Low bits of a word's hash that are its ending's; the word's own are the high 32.
ENDING = 255
_BLOCK_ROWS, _TREE = 1 << 14, 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Endings(dict):
    def __missing__(self, ending: bytes) -> int:
        self[ending] = out = xxhash.xxh32_intdigest(ending) & ENDING
        return out


_ENDINGS = _Endings()


def word_hashes(words: Collection[bytes]) -> np.ndarray:
    """32 bits of each word's hash and 8 of its ending's; for features and classes, not for counts."""
    own = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))
    return own << np.uint64(32) | np.fromiter((_ENDINGS[w[-2:]] for w in words), np.uint64, len(words))


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def word_classes(counts: np.ndarray, hashes: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """(n, LEVELS) classes. end: where the end of a text is; if not given, the first word is."""
    out = np.empty((len(counts), LEVELS), np.uint8)
    out[:, 0] = np.where(counts > 1, 1 + (hashes & np.uint64(ENDING)) % np.uint64(CLASSES - 2), 0)
    mixed = (hashes >> np.uint64(32)) * _MIX[2]
    for k in range(1, LEVELS):
        out[:, k] = (mixed >> np.uint64(64 - 16 * k) & np.uint64(0xFFFF)) % np.uint64(CLASSES)
    out[0 if end is None else end, 0] = CLASSES - 1
    return out


def leaves(classes: np.ndarray) -> np.ndarray:
    """A number for each innermost class; the rare class and the end have one each."""
    out = classes[:, 0].astype(np.int64)
    inner = (out > 0) & (out < CLASSES - 1)
    for k in range(1, LEVELS):
        out = out * CLASSES + np.where(inner, classes[:, k], 0)
    return out


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _open(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _open_tokens(data: bytes) -> np.ndarray:
    low, high = _open(data, "<u2").reshape(2, -1)
    return low | high.astype(np.uint32) << 16


def _squeeze_hashes(hashes: np.ndarray) -> bytes:
    return _squeeze(np.frombuffer((hashes >> np.uint64(32)).astype("<u4").tobytes() + hashes.astype(np.uint8).tobytes(), np.uint8))


def _open_hashes(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) << np.uint64(32) | np.frombuffer(raw, np.uint8, n, 4 * n)


# Batches ---------------------------------------------------------------------

_BATCH = "batch bigint, ids array<{}>, held binary, sizes binary, tokens binary, hashes binary"


class _Batch:
    def __init__(self):
        self.known: dict[bytes, int] = defaultdict(count().__next__)  # each new word gets the next number
        self.known[b""]  # the end is word 0; no word is empty
        self.ids, self.held, self.tokens, self.size = [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        words.append(b"")
        self.ids.append(doc_id)
        self.held.append(held_out(doc_id))
        self.tokens.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
        self.size += len(text or "") + 1

    def row(self, number: int):
        tokens, sizes, held = np.concatenate(self.tokens), np.array([len(t) for t in self.tokens], np.uint32), np.array(self.held)
        hashes = word_hashes(self.known)
        counts = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(hashes))
        return number, self.ids, held.tobytes(), _squeeze(sizes), _squeeze(np.stack([tokens & 0xFFFF, tokens >> 16]).astype("<u2")), _squeeze_hashes(hashes), list(self.known), counts


def batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored rows of many texts: the numbers of their words as tokens, and the batch's words with their training counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = _BATCH.format(kind.simpleString()) + ", words array<binary>, counts array<bigint>"

    def run(arrow_batches):
        number = TaskContext.get().partitionId() << 40
        now = None

        def out(b):
            n, ids, held, sizes, tokens, hashes, words, counts = b.row(number)
            columns = [pa.array([n]), pa.array([ids], pa.list_(id_type)), *[pa.array([x], pa.binary()) for x in (held, sizes, tokens, hashes)], pa.array([words], pa.list_(pa.binary())), pa.array([counts])]
            return pa.RecordBatch.from_arrays(columns, ["batch", "ids", "held", "sizes", "tokens", "hashes", "words", "counts"])

        id_type = None
        for arrow in arrow_batches:
            id_type = arrow.schema.field(0).type
            for doc_id, text in zip(arrow.column(0).to_pylist(), arrow.column(1)):
                now = now or _Batch()
                now.add(doc_id, text.as_py())
                if now.size >= BATCH:
                    yield out(now)
                    now, number = None, number + 1
        if now:
            yield out(now)

    return C.store(rows.mapInArrow(run, schema), "batches")


def with_counts(found: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Stored: the batches with the training counts of their words over the whole corpus."""
    width = C.shuffle_width(found.sparkSession)
    asked = found.select("batch", F.posexplode("words").alias("place", "word"))
    hot = F.col("c") * 4 * width > total
    listed = asked.join(F.broadcast(counts.where(hot).withColumnRenamed("c", "hot")), "word", "left")  # at most 4 * width rows
    near = listed.where("hot IS NOT NULL").select("batch", "place", F.col("hot").alias("c"))
    far = listed.where("hot IS NULL").select("batch", "place", "word").join(counts.where(~hot), "word").select("batch", "place", "c")
    given = near.unionByName(far).groupBy("batch").agg(F.collect_list(F.struct("place", "c")).alias("given"))
    names = [c for c in found.columns if c not in ("words", "counts")]
    joined = found.select(*names).join(given, "batch", "left")

    def merge(arrow_batches):
        for batch in arrow_batches:
            blobs = []
            for hashes, known in zip(batch.column("hashes"), batch.column("given")):
                c = np.zeros(len(_open_hashes(hashes.as_py())), np.uint64)
                if known.is_valid:
                    c[known.values.field("place").to_numpy()] = known.values.field("c").to_numpy().view(np.uint64)
                blobs.append(_squeeze(c))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(blobs, pa.binary())], [*names, "counts"])

    kind = found.schema["ids"].dataType.elementType.simpleString()
    return C.store(joined.mapInArrow(merge, _BATCH.format(kind) + ", counts binary"), "counted")


# Model -----------------------------------------------------------------------


@dataclass
class Vocabulary:
    """What holds for all words: N, V, and log10 P(w | leaf) as far as it doesn't hang on the word."""

    tokens: int
    types: int
    leaf_logs: np.ndarray  # log10 of the leaf's tokens
    rare_known: float  # log10 P(w | rare class) of a word seen once
    rare_unknown: float

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = np.log10(np.maximum(counts, 1)) - self.leaf_logs[leaves(classes)]
        out = np.where(classes[:, 0] == 0, np.where(counts > 0, self.rare_known, self.rare_unknown), out)
        return np.where(classes[:, 0] == CLASSES - 1, 0.0, out)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, c) of the training tokens, the end (the empty word) among them."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            c = batch.column(1).to_numpy()
            end = np.array([not w for w in words], bool)
            leaf = leaves(word_classes(c, word_hashes(words), end))
            kinds, place = np.unique(leaf, return_inverse=True)
            columns = [np.bincount(place, weights=w, minlength=len(kinds)).astype(np.int64) for w in (c, np.ones(len(c)), c == 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds, *columns)], ["leaf", "n", "v", "twice"])

    sums = counts.select("word", "c").mapInArrow(run, "leaf bigint, n bigint, v bigint, twice bigint")
    rows = sums.groupBy("leaf").agg(*[F.sum(x).alias(x) for x in ("n", "v", "twice")]).collect()  # one row for each leaf
    mass = np.zeros(CLASSES**LEVELS)
    for r in rows:
        mass[r.leaf] = r.n
    once, twice = sum(r.v for r in rows if r.leaf == 0), sum(r.twice for r in rows)
    unseen = min(once / (once + 2 * twice), 0.999) if once else 1.0
    known = np.log10((1 - unseen) / once) if once else -np.inf
    return Vocabulary(sum(r.n for r in rows), sum(r.v for r in rows), np.log10(np.maximum(mass, 1)), float(known), float(np.log10(unseen)))


def table_bits(tokens: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, (tokens // TOKENS_A_ROW).bit_length()))


def histories(hashes: np.ndarray, tokens: np.ndarray, places: np.ndarray, low: int, high: int) -> np.ndarray:
    """(features, n) hashes of the histories of the tokens from low to high; before a text's first word stands nothing.

    places: each token's place in its text.
    """
    at, place = np.arange(low, high), places[low:high]
    one = np.where(place < 1, np.uint64(1), hashes[tokens[np.maximum(at - 1, 0)]])
    two = np.where(place < 2, np.uint64(1), hashes[tokens[np.maximum(at - 2, 0)]])
    ends = (one & np.uint64(ENDING)) << np.uint64(16) | (two & np.uint64(ENDING))
    out = np.stack([one * _MIX[0], (one * _MIX[1] + two) * _MIX[2], (two ^ np.uint64(2)) * _MIX[3], (ends + np.uint64(3)) * _MIX[1], np.full(len(at), _MIX[2])])
    return out ^ out >> np.uint64(29)


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def slices(sizes: np.ndarray):
    """(first text, last text, first token, last token) of slices of whole texts; a longer text is one alone."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        start = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, start + SLICE, "right")))
        yield first, last, start, int(ends[last - 1])
        first = last


def level_rows(history: np.ndarray, classes: np.ndarray, bits: int):
    """For each softmax: which tokens have it, (features, n) rows of the table, and the classes chosen."""
    node = np.full(len(classes), _MIX[3])
    inner = (classes[:, 0] > 0) & (classes[:, 0] < CLASSES - 1)
    for k in range(LEVELS):
        which = np.flatnonzero(inner) if k else slice(None)
        rows = ((history[:, which] + node[which]) * _MIX[0] >> np.uint64(64 - bits)).astype(np.int64)
        rows[:WHOLE_WORDS] = (rows[:WHOLE_WORDS] * 3 >> 2) + (1 << bits - 2)
        rows[WHOLE_WORDS:] >>= 2
        yield which, rows, classes[which, k]
        node = (node + classes[:, k].astype(np.uint64) + np.uint64(1)) * _MIX[1]


def scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(n, CLASSES) scores after each history."""
    z = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0)
    return np.minimum(z, np.float32(80), out=z)


def logs(weights: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history) of one class each."""
    z = scores(weights, rows)
    chosen = z[np.arange(len(z)), own]
    return chosen - np.log(np.exp(z, out=z).sum(axis=1))


def learn(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
    """One gradient step in place; squares: the sum of squared gradients of each row so far."""
    g = scores(weights, rows)
    np.exp(g, out=g)
    g /= (g @ np.ones(CLASSES, np.float32))[:, None]
    g[np.arange(len(g)), own] -= 1

    def move(at: np.ndarray, by: np.ndarray) -> None:
        now = squares.take(at) + np.einsum("ij,ij->i", by, by) / np.float32(CLASSES)
        squares[at] = now
        by *= (np.float32(RATE) / np.sqrt(now + np.float32(1e-8)))[:, None]
        weights[at] = np.subtract(weights.take(at, axis=0), by, out=by)

    for r in rows:
        packed = np.sort(r << _PLACE | np.arange(len(r)))
        row, order = packed >> _PLACE, packed & (1 << _PLACE) - 1
        new = np.empty(len(row) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(row[1:], row[:-1], out=new[1:-1])
        alone = new[1:] & new[:-1]
        move(row[alone], g.take(order[alone], axis=0))
        many = ~alone
        if many.any():  # gradients of the same row are added up first
            first = np.flatnonzero(new[:-1][many])
            move(row[many][first], np.add.reduceat(g.take(order[many], axis=0), first, axis=0))


def _read(batch, names):
    get = lambda n: batch.column(names.index(n))
    for k in range(batch.num_rows):
        held, sizes = np.frombuffer(get("held")[k].as_py(), bool), _open(get("sizes")[k].as_py(), np.uint32).astype(np.int64)
        tokens, hashes, counts = _open_tokens(get("tokens")[k].as_py()), _open_hashes(get("hashes")[k].as_py()), _open(get("counts")[k].as_py(), np.uint64).astype(np.int64)
        yield get("ids")[k], held, sizes, tokens, hashes, counts


def learn_batch(weights: np.ndarray, squares: np.ndarray, held, sizes, tokens, hashes, counts) -> None:
    """All gradient steps over the training texts of a batch."""
    bits = len(weights).bit_length() - 1
    classes = word_classes(counts - 1, hashes)
    for first, last, start, end in slices(sizes):
        own, places, train = tokens[start:end], _places(sizes[first:last]), ~np.repeat(held[first:last], sizes[first:last])
        for low in range(0, len(own), STEP):
            high = min(low + STEP, len(own))
            taken = np.flatnonzero(train[low:high])
            if len(taken):
                history = histories(hashes, own, places, low, high)[:, taken]
                for _, rows, chosen in level_rows(history, classes[own[low:high][taken]], bits):
                    if len(chosen):
                        learn(weights, squares, rows, chosen)


_PART = "block int, part int, w binary"


def _packed_rows(rows: np.ndarray, squares: np.ndarray, weights: np.ndarray) -> bytes:
    return _squeeze(np.frombuffer(rows.astype("<i4").tobytes() + squares.astype("<f4").tobytes() + weights.astype("<f2").tobytes(), np.uint8))


def _unpacked_rows(data: bytes):
    raw = zstandard.decompress(data)
    n = len(raw) // (8 + 2 * CLASSES)
    return np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<f4", n, 4 * n), np.frombuffer(raw, "<f2", n * CLASSES, 8 * n).reshape(n, CLASSES)


def merged(parts: list[bytes]) -> bytes:
    """Rows of several tasks: each the mean of what the tasks made of it, by their squared gradients."""
    rows, squares, weights = map(np.concatenate, zip(*map(_unpacked_rows, parts)))
    found, place = np.unique(rows, return_inverse=True)
    total = np.bincount(place, weights=squares)
    mean = np.stack([np.bincount(place, weights=squares * weights[:, k].astype(np.float64)) for k in range(CLASSES)], axis=1) / total[:, None]
    return _packed_rows(found, total, mean)


def _round(counted: DataFrame, number: int, rounds: int, weights: np.ndarray, squares: np.ndarray, tasks: int) -> None:
    """One round, in place: over the batches whose turn it is, merged in two steps."""
    names = counted.columns
    start = counted.sparkSession.sparkContext.broadcast((weights, squares))

    def run(arrow_batches):
        first, before = start.value
        w, s, any_ = first.copy(), before.copy(), False
        for batch in arrow_batches:
            for _, *facts in _read(batch, names):
                learn_batch(w, s, *facts)
                any_ = True
        if any_:
            moved = np.flatnonzero(s > before)
            part = TaskContext.get().partitionId() % _TREE
            for block, rows in enumerate(np.split(moved, np.searchsorted(moved, range(_BLOCK_ROWS, len(w), _BLOCK_ROWS)))):
                if len(rows):
                    packed = _packed_rows(rows, s[rows] - before[rows], w[rows])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["block", "part", "w"])

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([table.column("block")[:1], table.column("part")[:1], pa.array([merged(table.column("w").to_pylist())], pa.binary())], ["block", "part", "w"])

    turn = counted.where(F.pmod(F.xxhash64("batch"), F.lit(rounds)) == number).coalesce(tasks)
    parts = turn.mapInArrow(run, _PART).groupBy("block", "part").applyInArrow(add, _PART).groupBy("block").applyInArrow(add, _PART)
    for r in parts.toLocalIterator():  # the weights, by blocks of fixed size
        rows, moved, new = _unpacked_rows(r.w)
        weights[rows] = new
        squares[rows] += moved
    start.destroy()


def train(counted: DataFrame, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    rows = 1 << table_bits(tokens)
    weights, squares = np.zeros((rows, CLASSES), np.float32), np.zeros(rows, np.float32)
    for number in range(rounds):
        _round(counted, number, rounds, weights, squares, max(1, tokens // (rounds * TASK_TOKENS_A_ROW * rows)))
    return weights


def words(facts: Vocabulary, hashes, counts) -> tuple[np.ndarray, np.ndarray]:
    """A batch's words: their classes, and log10 of their shares within the innermost one."""
    classes = word_classes(counts, hashes)
    return classes, facts.within(counts, classes)


def score_batch(weights: np.ndarray, facts: Vocabulary, sizes, tokens, hashes, counts, of_words=None) -> np.ndarray:
    """The model's log10 probability of each token. of_words: what words() gives, if it is known."""
    bits = len(weights).bit_length() - 1
    places, (classes, within) = _places(sizes), of_words or words(facts, hashes, counts)
    out = within[tokens]
    for low in range(0, len(tokens), STEP):
        high = min(low + STEP, len(tokens))
        history = histories(hashes, tokens, places, low, high)
        here = out[low:high]
        for which, rows, own in level_rows(history, classes[tokens[low:high]], bits):
            here[which] += logs(weights, rows, own) / np.log(10)
    return out


def scored(counted: DataFrame, weights: np.ndarray, facts: Vocabulary, id_col: str) -> DataFrame:
    names, kind = counted.columns, counted.schema["ids"].dataType.elementType.simpleString()
    shared = counted.sparkSession.sparkContext.broadcast(weights)
    scale = np.log10(facts.tokens + facts.types + 1)

    def run(arrow_batches):
        for batch in arrow_batches:
            for ids, held, sizes, tokens, hashes, counts in _read(batch, names):
                of_words, base, known = words(facts, hashes, counts), np.log10(counts + 1.0) - scale, counts > 0
                for first, last, low, high in slices(sizes):
                    n, own = sizes[first:last], tokens[low:high]
                    starts = np.cumsum(n) - n
                    sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731  used at once
                    columns = [held[first:last], n, sums(known[own].astype(np.int64)), np.full(len(n), facts.tokens), sums(base[own]), sums(score_batch(shared.value, facts, n, own, hashes, counts, of_words))]
                    yield pa.RecordBatch.from_arrays([ids.values.slice(first, last - first), *map(pa.array, columns)], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    found = batches(docs, id_col, text_col)
    pairs = found.select(F.inline(F.arrays_zip("words", "counts"))).where(F.col("counts") > 0)
    counts = C.store(pairs.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")), "words")
    facts = vocabulary(counts)
    counted = with_counts(found, counts, facts.tokens)
    C.discard(found)
    C.discard(counts)
    return scored(counted, train(counted, facts.tokens, rounds), facts, id_col)


def op3_maxent_lm(spark, sf_dir: str) -> DataFrame:
    return score(C.read(spark, sf_dir, "documents"))
