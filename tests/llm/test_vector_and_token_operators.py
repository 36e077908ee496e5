"""Vector codes, token files and hard negatives, each against plain Python."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import DATA

from attestra.llm import bpe, hard_negatives, token_files, vector_codes

ODD = [None, [], [1.0], [None, 1.0], [float("nan")], [float("inf")], [0.0] * 16, [0.0] * 16]


def scaled(x, scale):
    """A whole number within a long."""
    return max(min(math.floor(float(np.float32(x)) * scale), 2**63 - 1), -(2**63))


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int, v string, key string")


def clustered(n, seed, width=16, centres=6):
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(centres, width))
    return (near[rng.integers(0, centres, n)] + 0.2 * rng.normal(size=(n, width))).astype(np.float32)


# Vector codes --------------------------------------------------------------


def codes_by_hand(rows, scale, parts, entries, rounds):
    """(id, code, error, label_error) and the codebooks, with Python's whole numbers."""
    kept = [(i, [scaled(x, scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    cut = lambda v: [tuple(v[p * width // parts : (p + 1) * width // parts]) for p in range(parts)]
    first = sorted(((i, v) for i, v, _ in kept if i is not None))[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min((gap(x, y), e) for e, y in enumerate(books[p]))
    for _ in range(rounds if first else 0):
        held = {}
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                held.setdefault((p, nearest(p, x)[1]), []).append(x)
        for (p, e), xs in held.items():
            books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out = []
    for i, v, label in kept:
        found = [nearest(p, x) for p, x in enumerate(cut(v))] if first else []
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    top = 2**63 - 1
    total = {}
    for _, _, error, label in out:
        total[label] = total.get(label, 0) + min(error, top)
    return sorted(((i, c, min(e, top), min(total[label], top)) for i, c, e, label in out), key=repr), books


@pytest.mark.parametrize("case", ["clusters", "odd", "few", "huge", "empty"])
def test_vector_codes(spark, case):
    rng = np.random.default_rng(5)
    rows = {
        "clusters": [(i, v.tolist(), int(rng.integers(0, 3)) if i % 5 else None) for i, v in enumerate(clustered(400, 1))],
        "odd": [(i, v, 1) for i, v in enumerate(ODD)] + [(None, [2.0, 3.0], None), (20, [1.0] * 13, 2), (20, [1.0] * 12, 2)],
        "few": [(i, [float(i), -float(i)], None) for i in range(3)],
        "huge": [(i, [1e18 * (i % 7 - 3), 1.0, -1e17 * i, 3.5], i % 2) for i in range(40)],
        "empty": [],
    }[case]
    df = vectors_of(spark, [(*r, 1, "x", "y") for r in rows])
    got, books = vector_codes.compress(df)
    expected, by_hand = codes_by_hand(rows, 4096, 8, 16, 6)
    found = got.collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=repr) == expected
    assert [[tuple(int(x) for x in e) for e in b] for b in books.entries] == by_hand
    if case == "clusters":
        assert sum(r.refined for r in found) < 0.7 * len(found) * 8 * 16  # bounds rule entries out


def test_bounds_hold():
    rng = np.random.default_rng(2)
    entries, queries = rng.integers(-50, 50, (40, 5)), rng.integers(-80, 80, (300, 5))
    least, most = vector_codes.Approximation(entries).bounds(queries)
    exact = np.square(queries[:, None] - entries).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()


# Token files ---------------------------------------------------------------


def test_token_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_files.write(docs.repartition(3), folder)
    # by hand, in order: null ids first
    tokenizer = bpe._whole(bpe.WHOLE)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = [], 0
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = token_files.checksums(token_files.read(spark, folder))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_selective_reads(spark, tmp_path):
    texts = [f"document {i} " + "word " * (i % 50) for i in range(3000)]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    folder = f"{tmp_path}/tokens"
    token_files.write(docs, f"file://{folder}", row_group=64 << 10, page=4 << 10)
    whole = sorted((r.start, r.doc_id, r.tokens) for r in token_files.read(spark, folder).collect())
    flat = [t for _, _, tokens in whole for t in tokens]
    assert [d for _, d, _ in whole] == [i * 3 for i in range(3000)]
    for start, length in ((0, 10), (12345, 4000), (len(flat) - 5, 50), (7, 0), (len(flat), 3)):
        part = sorted(map(tuple, token_files.by_tokens(spark, folder, start, length).collect()), key=lambda r: r[1])
        assert [t for _, _, tokens in part for t in tokens] == flat[start : start + length]
        assert all(tokens == flat[s : s + len(tokens)] for _, s, tokens in part)
    some = token_files.by_ids(spark, folder, [3, 4, 8997])
    assert {r.doc_id: r.tokens for r in some.collect()} == {d: t for _, d, t in whole if d in (3, 8997)}
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [3,4,8997])]" in plan
    small = token_files.read(spark, folder, ["doc_id", "start", "n_tokens"])._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in small
    # the files are as the layout says
    for f in tmp_path.glob("tokens/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
            assert all(c.has_offset_index and c.has_column_index for n, c in columns.items() if "tokens" not in n)
    deltas = f"{tmp_path}/deltas"
    token_files.write(docs, f"file://{deltas}", token_dictionary=False)
    assert all("DELTA_BINARY_PACKED" in pq.ParquetFile(f).metadata.row_group(0).column(4).encodings for f in tmp_path.glob("deltas/*.parquet"))
    assert sorted((r.start, r.doc_id, r.tokens) for r in token_files.read(spark, deltas).collect()) == whole


def test_token_files_of_nothing(spark, docs, tmp_path):
    token_files.write(docs.limit(0), f"file://{tmp_path}/tokens")
    assert token_files.checksums(token_files.read(spark, f"file://{tmp_path}/tokens")).collect() == []


def test_token_files_of_a_table(spark):
    """The registered query by the tokenizers library, over a whole table."""
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op12_token_files(spark, f"{DATA}/sf0.001").collect()}
    tokenizer = bpe._whole(bpe.WHOLE)
    table = pq.read_table(f"{DATA}/sf0.001/documents.parquet").to_pylist()
    start = 0
    for r in sorted(table, key=lambda r: r["doc_id"]):
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(table)


# Hard negatives ------------------------------------------------------------


def mined_by_hand(rows, scale=256, k=5):
    kept = [(i, label, [scaled(x, scale) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in kept), default=0)
    kept = sorted((i, label, v + [0] * (width - len(v))) for i, label, v in kept)
    clip = lambda x: max(min(x, 2**63 - 1), -(2**63))
    out, asked = [], set()
    for i, label, v in kept:
        if i % 100 or i in asked:
            continue
        asked.add(i)
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w))), j, other) for j, other, w in kept if j != i)
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            good = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, positive, rank + 1, j, -p, -s) for rank, (s, j, _) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("case", ["clusters", "odd", "negative", "huge", "copies", "empty"])
def test_hard_negatives(spark, case, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = {
        "clusters": [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(clustered(900, 4))],
        "odd": [(i * 50, v, i % 2) for i, v in enumerate(ODD * 2)] + [(100, [1.0, 2.0], None), (None, [1.0], 1), (7, [0.5], 0), (100, [1.5], 0), (100, [1.5], 1)],
        "negative": [(i, [-1.0 if i % 100 else 1.0, 0.01 * i], i % 3 % 2) for i in range(300)],
        "huge": [(i, [1e17 * (i % 9 - 4), 1e16 * i], i % 2) for i in range(250)],
        "copies": [(i, [0.5, 0.25], i % 2) for i in range(400)],
        "empty": [],
    }[case]
    df = vectors_of(spark, [(*r, 1, "x", "y") for r in rows])
    got = hard_negatives.mine(df, df.vec_id % 100 == 0, df.label).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows)


def test_trees_prune(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(clustered(2000, 8, centres=20))]
    df = vectors_of(spark, [(*r, 1, "x", "y") for r in rows])
    tried = {r.anchor: r.evaluated for r in hard_negatives.evaluated(df, df.vec_id % 100 == 0, df.label).collect()}
    assert len(tried) == 20 and np.mean(list(tried.values())) < 0.5 * 2000 / 4


def test_node_bounds_hold():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-300, 300, (500, 12))
    tree = hard_negatives.BallTree.build(np.arange(500), rng.integers(0, 5, 500), vectors)
    q = rng.integers(-300, 300, 12)
    for (a, b, _), centre, radius in zip(hard_negatives._halves(500), tree.centres, tree.radii):
        scores, reach = tree.vectors[a:b] @ q, np.linalg.norm(q) * radius
        assert q @ centre - reach - 1 <= scores.min() and scores.max() <= q @ centre + reach + 1
    assert sorted(tree.ids.tolist()) == list(range(500))
