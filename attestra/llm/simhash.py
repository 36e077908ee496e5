"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint's bit is set if more than half of the shingle hashes have it. Exact
repeats of a fingerprint are one class from the start. Fingerprints that differ in k bits
or fewer agree in at least two of k + 2 blocks, so each is keyed by every pair of blocks;
fingerprints that share a key are joined and their distance is verified.

A key that more than `small` fingerprints share isn't joined with itself, which would grow
with the square. Its fingerprints are grouped by what they become when up to k/2 of the bits
outside the key are flipped: two within k bits meet in the middle, and all that
meet in one such value are within k bits of each other, so links to the least of
them are enough. That is exact, and linear in the fingerprints.

With shingles of five words, as unique() takes them, texts whose sets of shingles have a
Jaccard similarity of 0.8 or more are linked too, most of which differ in more bits than blocks can find. Candidates share one of BANDS
bands of ROWS minima over the set, which misses a pair of similarity 0.8 with a chance of 3 in
100,000; each candidate's similarity is then computed from the whole sets. Equal sets are
one from the start. Up to PAIRS sets that share a band are joined in pairs. Larger groups meet as
blocks, one for each task call: up to BLOCK sets are compared with the most central one, and those not
similar to it with all others, by products of incidence matrices; a block gives a spanning forest of its links.
A group beyond a block is dealt out by further bands that its sets may share, by two others first, then
by one at a time, until its parts are blocks; what is still too large after all TURNS is cut
by hashes. What that doesn't show is found exactly: in each group beyond a block the sets that aren't linked to most of
it are compared with all others of the group, in tiles of two blocks each. So every two sets that share a band and are similar
are linked in the end; the tiles are few if most are linked, and grow with the square of a group only where few are.

Defined results: null and empty texts have fingerprint zero and link like any other.
Rows with a null id link too, but give no name to a component; a component of null ids alone
has a null name. Repeated rows have the same class. Other columns aren't looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm import common as C
from attestra.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = 64
SEED = 42
_SLICE = 1 << 16
#: By the words of a shingle: the Jaccard similarity that links texts besides the fingerprints' distance.
SIMILARITY = {5: 0.8}
#: Bands of minima, and minima in each; sets of a band that are joined in pairs.
BANDS, ROWS, PAIRS = 20, 4, 6
#: Sets of a block and hashes in them; by how many further bands each turn deals out.
BLOCK, BLOCK_HASHES, TURNS = 1024, 4_000_000, (2, 1, 1, 1, 1, 1)
_KEYS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64)
#: Names that this operator adds start so.
_P = "_sh_"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1)
    set_bits = np.zeros(BITS, np.int64)
    for start in range(0, n, _SLICE):
        hashes = np.array([digest(join(words[i : i + shingle]), SEED) for i in range(start, min(n, start + _SLICE))], np.dtype(">u8"))
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((digest(join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band's minima over a set of shingles; none for the empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(found), 4096):
        x = found[start : start + 4096, None] * (_KEYS[0] | np.uint64(1)) + _KEYS[1]
        x ^= x >> np.uint64(29)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def block_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted, distinct hashes) of that Jaccard similarity."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(n), sizes)
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = counts[code] > 1
    of, code, often = of[kept], code[kept], counts
    root = list(range(n))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))

    near = lambda both, i: both >= similarity * (sizes[i][..., None] + sizes - both)
    # The set that shares most with all others, for its size, first.
    central = int((np.bincount(of, often[code], n) / np.maximum(sizes, 1)).argmax())
    mark = np.zeros(len(counts), bool)
    mark[code[of == central]] = True
    both = np.bincount(of[mark[code]], minlength=n)
    both[central] = sizes[central]
    linked = near(both, np.array(central)).reshape(-1)
    for k in np.flatnonzero(linked):
        link(central, int(k))
    rest = np.flatnonzero(~linked)
    if len(rest) and n > 1:
        asked = np.zeros(len(counts), bool)
        asked[code[np.isin(of, rest)]] = True
        column = np.cumsum(asked) - 1
        use = asked[code]
        rows, columns = of[use], column[code[use]]
        both = np.zeros((len(rest), n), np.float32)
        for a in range(0, int(asked.sum()), 8192):
            here = (columns >= a) & (columns < a + 8192)
            table = np.zeros((n, 8192), np.float32)
            table[rows[here], columns[here] - a] = 1
            both += table[rest] @ table.T
        for i, k in np.argwhere(near(both, rest)):
            if rest[i] != k:
                link(int(rest[i]), int(k))
    return out


def tile_links(asks: list[np.ndarray], others: list[np.ndarray], asks_roots: list[int], others_roots: list[int], similarity: float) -> list[tuple[int, int]]:
    """(asking, other): links of that Jaccard similarity between sets of different roots, one for each asking set and root."""
    sizes = [np.array([len(x) for x in side]) for side in (asks, others)]
    _, code = np.unique(np.concatenate([*asks, *others]), return_inverse=True)
    of = [np.repeat(np.arange(len(n)), n) for n in sizes]
    codes = code[: sizes[0].sum()], code[sizes[0].sum() :]
    common = np.zeros(int(code.max()) + 1, bool)
    common[np.intersect1d(*codes)] = True
    column = np.cumsum(common) - 1
    both = np.zeros((len(asks), len(others)), np.float32)
    for a in range(0, int(common.sum()), 8192):
        tables = []
        for rows, c, n in zip(of, codes, sizes):
            here = common[c] & (column[c] >= a) & (column[c] < a + 8192)
            tables.append(np.zeros((len(n), 8192), np.float32))
            tables[-1][rows[here], column[c[here]] - a] = 1
        both += tables[0] @ tables[1].T
    roots = [np.array(r, np.int64) for r in (asks_roots, others_roots)]
    near = (both >= similarity * (sizes[0][:, None] + sizes[1] - both)) & (roots[0][:, None] != roots[1])
    return [(i, int(k)) for i in range(len(asks)) for k in np.flatnonzero(near[i])[np.unique(roots[1][near[i]], return_index=True)[1]]]


def similar(docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links between fingerprints of texts whose sets of shingles are so similar."""

    def measure(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(0)]
            sets = [shingles(t, shingle) for t in texts]
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(prints), pa.array([bands(x) for x in sets], pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64())], ["s", "fp", "bands", "size"])

    rows = C.store(docs.select(F.col(text_col).alias("text")).mapInArrow(measure, "s bigint, fp bigint, bands array<bigint>, size bigint"), "bands")
    # Equal sets may have several fingerprints, if shingles repeat.
    prints = rows.select("s", "fp").distinct()
    one = prints.groupBy("s").agg(F.min("fp").alias("least"))
    same = prints.join(one, "s").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    sets = rows.where(F.size("bands") > 0).groupBy("s").agg(F.first("bands").alias("bands"), F.first("size").alias("size"))
    keyed = sets.select("s", "size", F.posexplode("bands").alias("band", "key")).withColumn("key", F.xxhash64("band", "key"))
    shared = _shared(keyed)

    # The whole sets, of the candidates alone.
    asked = shared.select("s").distinct()

    def again(batches):
        for batch in batches:
            sets = [shingles(x.as_py(), shingle) for x in batch.column(0)]
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array([x.tobytes() for x in sets], pa.binary())], ["s", "hashes"])

    texts = docs.select(F.col(text_col).alias("text")).mapInArrow(again, "s bigint, hashes binary")
    whole = C.store(texts.join(asked, "s", "left_semi").dropDuplicates(["s"]), "sets")

    def compare(batches):
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                if both >= similarity * (len(x) + len(y) - both):
                    kept.append(k)
            yield batch.select(["s", "t"]).take(pa.array(kept, pa.int64()))

    def verified(candidates: DataFrame) -> DataFrame:
        """The pairs (s, t) of the candidates that are similar; one t may have most of the pairs."""
        candidates = C.store(candidates.distinct(), "candidates")
        left = candidates.join(whole, "s").select("s", "t", F.col("hashes").alias("x"))
        often = candidates.groupBy("t").agg(F.count("*").alias("n"))
        both = C.salted_join(left, whole.select(F.col("s").alias("t"), F.col("hashes").alias("y")), "t", "s", often)
        out = C.store(both.select("s", "t", "x", "y").mapInArrow(compare, "s bigint, t bigint"), "similar")
        C.discard(candidates)
        return out

    def all_pairs(groups: DataFrame) -> DataFrame:
        few = groups.where(F.col("n") <= PAIRS).select("s", "key")
        return few.join(few.withColumnRenamed("s", "t"), "key").where("s < t").select("s", "t")

    def within(batches):
        """Links of the blocks, which come one after the other."""
        held: list[tuple[int, np.ndarray]] = []
        now = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                key, name, hashes = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), np.frombuffer(batch.column(2)[k].as_py(), np.uint64)
                if key != now:
                    found += [(held[i][0], held[j][0]) for i, j in block_links([h for _, h in held], similarity)] if held else []
                    held, now = [], key
                held.append((name, hashes))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["s", "t"])
        if held:
            found = [(held[i][0], held[j][0]) for i, j in block_links([h for _, h in held], similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["s", "t"])

    blocks_ = _blocks(shared.where(F.col("n") > PAIRS).select("s", "key", "band", "n", "total"), sets)
    met = C.store(blocks_.join(whole, "s").select("block", "s", "hashes").repartition("block").sortWithinPartitions("block").mapInArrow(within, "s bigint, t bigint"), "met")
    out = verified(all_pairs(shared)).union(met)

    def across(batches):
        """Links of the tiles, which come one after the other: of sets that ask to sets of other roots."""
        held: list[tuple] = []
        now = None

        def told() -> pa.RecordBatch:
            asks, others = [r for r in held if r[1]], [r for r in held if not r[1]]
            found = tile_links([r[3] for r in asks], [r[3] for r in others], [r[2] for r in asks], [r[2] for r in others], similarity) if asks and others else []
            return pa.RecordBatch.from_arrays([pa.array([asks[i][0] for i, _ in found], pa.int64()), pa.array([others[k][0] for _, k in found], pa.int64())], ["s", "t"])

        for batch in batches:
            for k in range(batch.num_rows):
                tile, name, asking, root, hashes = (c[k].as_py() for c in batch.columns)
                if tile != now and held:
                    yield told()
                    held = []
                now = tile
                held.append((name, asking, root, np.frombuffer(hashes, np.uint64)))
        if held:
            yield told()

    # What the parts of a large group don't show: sets that they left apart from most meet all of the group.
    large = shared.where(~_fits())
    if large.take(1):
        tiles = _tiles(large, components(out.select(F.col("s").alias("a"), F.col("t").alias("b"))))
        whole_tiles = tiles.join(whole, "s").select("tile", "s", "asks", "root", "hashes").repartition("tile").sortWithinPartitions("tile")
        out = out.union(C.store(whole_tiles.mapInArrow(across, "s bigint, t bigint"), "across"))
    named = lambda c, to: one.select(F.col("s").alias(c), F.col("least").alias(to))
    return C.store(out.join(named("s", "a"), "s").join(named("t", "b"), "t").select("a", "b").union(same).where("a <> b").distinct(), "linked")


def _shared(keyed: DataFrame) -> DataFrame:
    """keyed (s, size, key, ...) with n and total, stored: the keys that n > 1 sets share, and the hashes in them."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    return C.store(C.salted_join(keyed, sizes.where("n > 1"), "key", "s", sizes.select("key", "n")), "shared")


def _fits() -> Column:
    """Groups that are compared whole."""
    return (F.col("n") <= PAIRS) | ((F.col("n") <= BLOCK) & (F.col("total") <= BLOCK_HASHES))


def _tiles(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile, s, asks, root): in each group (s, size, key, n, total) what isn't of the commonest root asks all sets of the group.

    Two sets of a group with different roots can't both be of the commonest one, so they meet. Both sides are dealt into parts of a block's
    size, and each two parts are a tile. No two sets of one root are in question.
    """
    rooted = large.join(roots, F.col("s") == F.col("node"), "left").select("s", "size", "key", F.coalesce("root", "s").alias("root"))
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    most = by_root.groupBy("key").agg(F.max(F.struct("n", "total", "root")).alias("most"), F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > most.n")
    parts = lambda n, total: F.ceil(F.greatest(n / BLOCK, total / BLOCK_HASHES)).cast("int")
    cuts = most.select("key", F.col("most.root").alias("main"), parts(F.col("n"), F.col("total")).alias("a"), parts(F.col("n") - F.col("most.n"), F.col("total") - F.col("most.total")).alias("b"))
    known = C.store(C.salted_join(rooted, cuts, "key", "s", most.select("key", "n")), "rooted")
    place = lambda cut: F.pmod(F.xxhash64("s"), F.col(cut)).cast("int")
    all_of_them = known.select("s", "root", F.lit(False).alias("asks"), "key", F.explode(F.expr("sequence(0, b - 1)")).alias("i"), place("a").alias("j"))
    asking = known.where("root <> main").select("s", "root", F.lit(True).alias("asks"), "key", place("b").alias("i"), F.explode(F.expr("sequence(0, a - 1)")).alias("j"))
    return all_of_them.union(asking).select(F.xxhash64("key", "i", "j").alias("tile"), "s", "asks", "root")


def _blocks(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, s): the groups (s, key, band, n, total) as blocks; sets: (s, bands, size)."""
    fits = _fits()
    out = [groups.where(fits).select(F.col("key").alias("block"), "s")]
    bit = lambda b: F.call_function("shiftleft", F.lit(1), b)
    large = groups.where(~fits).withColumn("used", bit(F.col("band")))
    for turn in TURNS:
        if not large.take(1):
            return reduce(DataFrame.union, out)
        free = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.expr("used").bitwiseAND(bit(b)) == 0)
        chosen = F.transform(F.sequence(F.lit(0), F.lit(turn - 1)), lambda i: F.element_at("free", (F.pmod(F.xxhash64("key") + i, F.size("free")) + 1).cast("int")))
        dealt = large.select("s", "key", "used").withColumn("free", free).select("s", "key", "used", F.explode(chosen).alias("next")).join(sets, "s")
        keyed = dealt.select("s", "size", F.xxhash64("key", "next", F.element_at("bands", F.col("next") + 1)).alias("key"), F.col("used").bitwiseOR(bit(F.col("next"))).alias("used"))
        parts = _shared(keyed)
        out.append(parts.where(fits).select(F.col("key").alias("block"), "s"))
        large = parts.where(~fits).select("s", "key", "used", "n", "total")
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_HASHES))
    out.append(large.select(F.xxhash64("key", F.pmod(F.xxhash64("s"), cuts)).alias("block"), "s"))
    return reduce(DataFrame.union, out)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def blocks(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 2 blocks of nearly equal width, from the low end."""
    n = distance + 2
    edges = [round(BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(pair: tuple[tuple[int, int], ...]) -> int:
    return sum(((1 << w) - 1) << s for s, w in pair)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(prints: DataFrame, distance: int = 2, small: int = 32) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints fp that connect just what differs in `distance` bits or fewer."""
    if distance % 2:
        raise ValueError("the distance must be even: fingerprints meet halfway")
    pairs = list(combinations(blocks(distance), 2))
    masks = [_mask(p) for p in pairs]
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.expr(f"fp & {_signed(m)}L").alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.pair", "k.key")
    sizes = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = C.store(keyed.join(sizes, ["pair", "key"]), "blocks")

    near = shared.where(F.col("n") <= small)
    other = near.select("pair", "key", F.col("fp").alias("other"))
    joined = near.join(other, ["pair", "key"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    out = joined.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    flips = lambda m: [1 << i for i in range(BITS) if not m >> i & 1]
    spread = lambda m: [sum(c) for n in range(distance // 2 + 1) for c in combinations(flips(m), n)]
    hot = shared.where(F.col("n") > small)
    variants = F.expr("CASE " + " ".join(f"WHEN pair = {i} THEN array({', '.join(f'fp ^ {_signed(x)}L' for x in spread(m))})" for i, m in enumerate(masks)) + " END")
    met = hot.select("pair", "fp", F.explode(variants).alias("middle"))
    least = met.groupBy("pair", "middle").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("pair", "middle", "least")
    star = met.join(least, ["pair", "middle"]).where("fp > least")
    return out.union(star.select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the least id that links reach."""
    prints = C.store(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    edges = links(distinct.select("fp"), distance)
    if shingle in SIMILARITY:
        edges = edges.union(similar(docs, text_col, shingle, SIMILARITY[shingle]))
    roots = components(edges)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = C.store(rooted.join(named, "root").select(F.col("fp").alias("of_fp"), "component_id"), "classes")
    return prints.join(named, F.col("fp") == F.col("of_fp")).select(F.col("id").alias(id_col), "fp", "component_id")


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 5) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least id stays.

    Of repeated rows with that id one stays, that with the least other columns. Null ids come
    first. The texts are shuffled once, by their ids and hashes.
    """
    names, i, k = docs.columns, _P + "id", _P + "key"
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key")).alias("row"), text_col)
    found = classes(keyed, "row", text_col, distance, shingle)
    first = found.groupBy("component_id").agg(F.min("row").alias("row")).select(F.col("row.id").alias(i), F.col("row.key").alias(k))
    rows = docs.withColumn(_P + "of", F.xxhash64(text_col))
    kept = rows.join(first, rows[id_col].eqNullSafe(F.col(i)) & (F.col(_P + "of") == F.col(k)))
    rest = [c for c in names if c not in (id_col, text_col)]
    number = F.row_number().over(W.partitionBy(id_col, _P + "of").orderBy(*[F.col(f"`{c}`") for c in rest], F.lit(0)))
    return kept.withColumn(_P + "n", number).where(F.col(_P + "n") == 1).select(*[F.col(f"`{c}`") for c in names])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
