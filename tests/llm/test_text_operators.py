import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers import DATA
from tokenizers import Tokenizer

from attestra.llm import bpe, components, html_text, maxent_lm, packing, quality_rules, secrets, simhash, topk, url_filters

SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


# 1 quality rules --------------------------------------------------------------


def test_quality_base_statistics(docs, texts_of):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect()), key=repr)
    expected = []
    for i, t in texts_of:
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed))
    assert got == sorted(expected, key=repr)


def test_quality_counts_distinct_documents(spark):
    """Two frequent lines on the same pages, pages of shared lines alone, copies, and a text under two hosts."""
    rng = random.Random(9)
    own = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(10**6)) + "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared = [own(30) for _ in range(6)]
    texts = [("h", own(60) + "\n" + shared[0] + "\n" + shared[1]) for _ in range(15)]
    texts += [("h", "\n".join(rng.sample(shared[2:], 2)) + "\n" + own(1)) for _ in range(40)]
    copy = own(70)
    texts += [("h", copy)] * 30 + [("g", t) for _, t in texts[:5]] + [("g", own(60) + "\n" + shared[0])] * 3 + [(None, shared[0])]
    rows = [(i, t, h) for i, (h, t) in enumerate(texts)] + [(0, texts[0][1], "g"), (0, texts[0][1], "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    normal = lambda line: lower(" ".join(words(line))).translate({c: 48 for c in range(49, 58)})
    holds, sizes = {}, {}
    for _, t, h in rows:
        sizes.setdefault(h, set()).add(t)
        for line in t.split("\n"):
            holds.setdefault((h, normal(line)), set()).add(t)
    above = {k for k, v in holds.items() if len(v) > 10 and 100 * len(v) > len(sizes[k[0]])}
    assert len(above) >= 6
    expected = []
    for i, t, h in rows:
        n, gone = len(words(t)), sum(len(words(x)) for x in t.split("\n") if (h, normal(x)) in above)
        expected.append((i, n, gone, n >= 50 and (n - gone) * 100 >= 20 * n))
    got = [(r.doc_id, r.n_words, r.removed_words, r.kept) for r in quality_rules.judge(df).collect()]
    assert sorted(got) == sorted(expected)
    cleaned = quality_rules.clean(df)
    kept = sorted((r.doc_id, r.source, r.text) for r in cleaned.where("source IS NOT NULL").collect())
    left = lambda t, h: "\n".join(x for x in t.split("\n") if (h, normal(x)) not in above)
    assert kept == sorted((i, h, left(t, h)) for (i, t, h), e in zip(rows, expected) if e[3] and h)


def test_quality_removes_frequent_lines(spark):
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(70))
    rows = [(i, text() + "\nAll rights reserved 2024, see the terms", "a") for i in range(40)] + [(99, "\n".join(["All rights reserved 2024, see the terms"] * 12), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in quality_rules.clean(df).collect()}
    assert set(out) == set(range(40)) and not any("rights" in t for t in out.values())
    assert quality_rules.clean(df.limit(0)).count() == quality_rules.judge(df.limit(0)).count() == 0


def test_quality_clean_counts_distinct_texts(spark):
    """Two template lines, one of the least hash, hide each other if documents are known by their least other line."""
    rng = random.Random(11)
    text = lambda: "\n".join(" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(35)) for _ in range(2))
    lines = [" ".join(f"t{chr(97 + k)}{c}" for c in "abcde") for k in range(12)]
    mine = [text() for _ in range(40)]
    rows = [(i, t + "\n" + "\n".join(lines), "a") for i, t in enumerate(mine)]
    copy = text()
    rows += [(100 + i, copy, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in quality_rules.clean(df).collect()}
    assert set(out) == {r[0] for r in rows} and all(out[i] == t for i, t in enumerate(mine)) and out[100] == copy


# 2 main text -------------------------------------------------------------------


def test_main_text(spark):
    rng = random.Random(2)
    own = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(30)]
    page = lambda t: f"<html><head><title>x</title><style>p{{}}</style></head><body><nav>Home</nav><div><p>{t[:150]} &amp;\n b</p><p>{t[150:]}</p><p>Call us today at our office</p></div><div class='comments'>nice</div><footer>f</footer><script>1</script></body></html>"
    rows = [(i, f"http://A.com/{i}", page(t), "k") for i, t in enumerate(own)] + [(90, None, None, None), (91, "x", "", None), (92, "x", "plain words", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i, t in enumerate(own):
        assert got[i] == f"{' '.join((t[:150] + ' & b').split())}\n{' '.join(t[150:].split())}"
    assert got[90] == got[91] == "" and got[92] == "plain words"
    assert html_text.extract(df.limit(0)).count() == 0


def test_template_of_short_pages_sections_and_small_hosts(spark):
    rng = random.Random(12)
    own = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    notice = "<div><p>" + "Our office is open on weekdays. " * 10 + "</p></div>"
    body = lambda t, extra="": f"<html><body><div><p>{t}</p></div>{extra}</body></html>"
    short = [own(20) for _ in range(30)]
    rows = [(i, f"http://short.com/{i}", body(t, notice)) for i, t in enumerate(short)]  # more template than text
    part = [own(40) for _ in range(100)]
    rows += [(100 + i, f"http://part.com/{i}", body(t, notice if i < 33 else "")) for i, t in enumerate(part)]  # one section's
    small = [own(40) for _ in range(5)]
    rows += [(300 + i, f"http://small.com/{i}", body(t, notice)) for i, t in enumerate(small)]
    copied = own(60)
    rows += [(400 + i, f"http://copies.com/{i}", body(copied)) for i in range(40)]
    rows += [(500 + i, f"http://copies.com/x{i}", body(own(40))) for i in range(5)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(30)] == short
    assert [got[100 + i] for i in range(100)] == part
    assert [got[300 + i] for i in range(5)] == small
    assert all(got[400 + i] == copied for i in range(40))


def test_templates_by_counting(spark):
    """Texts from subtrees counted in plain Python, on hosts whose pages share random parts in random places."""
    rng = random.Random(21)
    own = lambda n: " ".join(f"v{rng.randrange(99999)}" for _ in range(n))
    leaf = lambda n: ("p", own(n))
    rows, trees = [], {}
    for host, n in (("a.com", 60), ("b.com", 25), ("c.com", 6), ("d.com", 2)):
        shared = [leaf(8), ("div", [leaf(5), leaf(6)]), ("section", [("div", [leaf(4)]), leaf(3)]), leaf(4)]
        for k in range(n):
            parts = [leaf(12), ("div", [leaf(9), *([shared[3]] if rng.random() < 0.05 else [])])] + [x for x in shared[:3] if rng.random() < 0.6]
            rng.shuffle(parts)
            trees[len(rows)] = (host, ("body", [("nav", [leaf(2)]), *parts]))
            rows.append((len(rows), f"http://{host}/{k}"))
    html = lambda t: f"<{t[0]}>" + (t[1] if isinstance(t[1], str) else "".join(map(html, t[1]))) + f"</{t[0]}>"
    inner = lambda t: [t] + ([] if isinstance(t[1], str) else [y for x in t[1] for y in inner(x)])
    pages, counts = Counter(h for h, _ in trees.values()), Counter()
    for h, t in trees.values():
        counts.update({(h, repr(x)) for x in inner(t)})
    template = {k for k, n in counts.items() if n > 10 and n > 0.01 * pages[k[0]] or n >= 3 and 2 * n > pages[k[0]]}
    assert len(template) > 12
    left = lambda h, t: [] if (h, repr(t)) in template or t[0] == "nav" else [t[1]] if isinstance(t[1], str) else [y for x in t[1] for y in left(h, x)]
    df = spark.createDataFrame([(i, u, html(trees[i][1])) for i, u in rows] + [(0, rows[0][1], html(trees[0][1]))], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) + 1 and {(r.page_id, r.text) for r in got} == {(i, "\n".join(left(*trees[i]))) for i, _ in rows}


def test_names_keep_the_main_element():
    """A class doesn't take away what holds the main element or the only article; comments and related ones go."""
    text = lambda h: html_text.parse(h).blocks
    assert text("<div class='content-sidebar'><main><p>one</p></main><div class='sidebar'>two</div></div>") == ["one"]
    assert text("<div class='share-wrap'><article><p>one</p></article></div><div class='comments'><article class='comment'>two</article></div>") == ["one"]
    assert text("<div><p>one</p></div><div class='related'><article>two</article><article>three</article></div>") == ["one"]
    assert text("<article>one</article><article class='comment'>two</article><article id='replies'>three</article>") == ["one"]
    assert text("<div><article class='comment'>two</article></div>") == ["two"]
    deep = "<b>" * 30_000 + "<p>x" * 3_000
    assert text(deep) == ["x"] * 3_000
    assert len(text("<p><table>" + "<i>" * 30_000 + "<div>y" * 3_000)) == 3_000


def test_articles_keep_what_they_share(spark):
    """A closing paragraph on a tenth of the host's articles stays; the same outside of articles, or on most of them, goes."""
    rng = random.Random(31)
    own = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(30))
    closing, notice, most = "This text may be shared with its source.", "Our office is open on weekdays.", "All rights are reserved by us."
    texts = [own() for _ in range(200)]
    inner = lambda i: f"<p>{texts[i]}</p>" + (f"<p>{closing}</p>" if i % 10 == 0 else "") + (f"<p>{most}</p>" if i % 3 else "")
    rows = [(i, f"http://a.com/{i}", f"<body><article>{inner(i)}</article><div class='x'>{notice}</div><article class='comment'>nice {i}</article></body>") for i in range(100)]
    rows += [(i, f"http://b.com/{i}", f"<body><div>{inner(i)}</div></body>") for i in range(100, 200)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == texts[i] + (f"\n{closing}" if i % 10 == 0 else "") for i in range(100))
    assert all(got[i] in (texts[i], f"{texts[i]}\n{closing}") for i in range(100, 200))  # ten pages are no template, more would be


# 3 language model ------------------------------------------------------------------


def test_language_model(spark, docs):
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        toks = [[*words(lower(r.text or "")), ""] for r in rows]
        held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]
        c = Counter(w for t, h in zip(toks, held) if not h for w in t)
        n, v = sum(c.values()), len(c)
        base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)  # noqa: B023, E731
        expected = sorted(((r.doc_id, h, len(t), sum(c[w] > 0 for w in t), n, round(base(t), 4)) for r, h, t in zip(rows, held, toks)), key=repr)
        scored = maxent_lm.score(df).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored), key=repr) == expected
        assert all(r.score < 0 and math.isfinite(r.score) for r in scored)
    unseen = [r for r in scored if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert maxent_lm.score(docs.limit(0)).count() == 0
    nothing = maxent_lm.score(docs.where("doc_id = 7").withColumn("doc_id", docs.doc_id * 0 + next(i for i in range(99) if maxent_lm.held_out(i)))).first()
    assert nothing.train_tokens == 0 and nothing.n_known == 0


def test_score_of_given_weights():
    """The model's probability of each token, from its definition, for any weights; all of a history's sum to one."""
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << 8, maxent_lm.CLASSES)).astype(np.float32)
    words = [b"", b"the", b"cat", b"sat", b"rare", b"new"]
    hashes = maxent_lm.word_hashes(words)
    counts, texts = np.array([3, 5, 2, 4, 1, 0]), [[1, 2, 3, 0], [0], [4, 1, 5, 1, 0]]
    tokens, sizes = np.concatenate(texts).astype(np.uint32), np.array([len(t) for t in texts])
    classes = maxent_lm.word_classes(counts, hashes)
    mass = np.bincount(maxent_lm.leaves(classes), weights=counts, minlength=maxent_lm.CLASSES**maxent_lm.LEVELS)
    facts = maxent_lm.Vocabulary(15, 5, np.log10(np.maximum(mass, 1)), math.log10(0.7), math.log10(0.3))
    got = maxent_lm.score_batch(weights, facts, sizes, tokens, hashes, counts)

    mask, mix = (1 << 64) - 1, [int(x) for x in maxent_lm._MIX]
    h = lambda w: int(hashes[w])

    def logs(before, w):
        one, two = h(before[-1]) if before else 1, h(before[-2]) if len(before) > 1 else 1
        end = maxent_lm.ENDING
        features = [one * mix[0], (one * mix[1] + two) * mix[2], (two ^ 2) * mix[3], (((one & end) << 16 | two & end) + 3) * mix[1], mix[2]]
        features = [(x & mask) ^ (x & mask) >> 29 for x in features]
        node, total, path = mix[3], 0.0, [int(c) for c in classes[w]]
        for k, own in enumerate(path if 0 < path[0] < maxent_lm.CLASSES - 1 else path[:1]):
            rows = [((f + node) * mix[0] & mask) >> 56 for f in features]
            rows = [(r * 3 >> 2) + 64 if n < 3 else r >> 2 for n, r in enumerate(rows)]
            z = sum(weights[r].astype(float) for r in rows)
            assert sum(math.exp(x) for x in z - np.log(np.exp(z).sum())) == pytest.approx(1)
            total += z[own] - np.log(np.exp(z).sum())
            node = (node + own + 1) * mix[1] & mask
        if path[0] == 0:
            return total / math.log(10) + math.log10(0.7 if counts[w] else 0.3)
        same = [v for v in range(len(words)) if list(classes[v]) == path]
        return total / math.log(10) + (0 if w == 0 else math.log10(counts[w] / sum(counts[v] for v in same)))

    expected = [logs(t[:k], w) for t in texts for k, w in enumerate(t)]
    assert got == pytest.approx(expected, abs=1e-4)
    assert maxent_lm._open_hashes(maxent_lm._squeeze_hashes(hashes)).tolist() == hashes.tolist()


def test_learning_adds_gradients_of_a_row():
    """A step moves each row by its summed gradient, scaled; merged rows are means by squared gradients."""
    rng = np.random.default_rng(1)
    rows, own = rng.integers(0, 6, (2, 40)) + np.array([[0], [6]]), rng.integers(0, maxent_lm.CLASSES, 40)
    w, s = rng.normal(size=(12, maxent_lm.CLASSES)).astype(np.float32), np.zeros(12, np.float32)
    z = np.exp(w[rows[0]] + w[rows[1]])
    g = z / z.sum(axis=1, keepdims=True)
    g[np.arange(40), own] -= 1
    expected = w.copy()
    for r in range(12):
        total = g[(rows == r).any(axis=0)].sum(axis=0)
        if (rows == r).any():
            expected[r] -= maxent_lm.RATE * total / math.sqrt((total**2).mean() + 1e-8)
    maxent_lm.learn(w, s, rows, own)
    assert w == pytest.approx(expected, abs=1e-4)
    one = np.ones((1, maxent_lm.CLASSES))
    both = maxent_lm.merged([maxent_lm._packed_rows(np.array([3]), np.array([1.0]), one), maxent_lm._packed_rows(np.array([3, 9]), np.array([3.0, 2.0]), np.concatenate([3 * one, 5 * one]))])
    found, squares, weights = maxent_lm._unpacked_rows(both)
    assert (found.tolist(), squares.tolist(), weights[:, 0].tolist()) == ([3, 9], [4, 2], [2.5, 5])


# 4 url filters ------------------------------------------------------------------------


def test_url_filters(spark):
    rules = [("com", "/", "allow"), ("com", "/a", "block"), ("b.com", "/a/b", "allow"), ("x.b.com", "/", "block"), ("net", "/a", "block"), ("b.com", "/a/", "block"), ("c.com", "", "block"), ("y.x.c.com", "/b", "allow"), ("-x.com", "/", "block")]
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "ftp://COM/a?b#c", "http://acom/a"]
    urls += [f"http://{rng.choice(['', 'x.', 'y.x.', 'X.'])}{rng.choice(['b.com', 'c.com', 'b.net', 'org'])}{rng.choice(['', '/', '/a', '/a/', '/a/b', '/a/bc', '/b?/a', '#/a'])}" for _ in range(200)]
    urls += ["http://a.-x.com/", "http://-x.com/q", "http://y.x.c.com/b/c"]
    df = spark.createDataFrame([*enumerate(urls), (7, urls[7]), (7, urls[7]), (None, urls[8])], "page_id long, url string")
    assert url_filters.classify(df, url_filters.rules_frame(spark, rules)).count() == len(urls) + 3
    for r in url_filters.classify(df, url_filters.rules_frame(spark, rules)).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0]))) if fits else None
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert url_filters.classify(df.limit(0), url_filters.rules_frame(spark)).count() == 0


# 6 byte-pair encoding -----------------------------------------------------------------


def test_bpe_is_the_tokenizers(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, bpe.hashes, "n_tokens bigint, ids_sha256 string, decoded_sha256 string").collect()), key=repr)
        expected = []
        for r in df.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            sha = lambda b: hashlib.sha256(b).hexdigest()
            expected.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
        assert got == sorted(expected, key=repr)
    assert bpe.encode(docs.limit(0), bpe.with_ids, "ids array<int>").count() == 0


def test_bpe_very_long_pieces():
    """Blanks, letters of scripts without blanks, and periodic texts, against the tokenizers library."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200_000))
    texts = ["one two three" + " " * 1_000_000 + "four", "a" + "\n \t" * 200_000 + "b", " " * 5_000_000, cjk, "ab" * 300_000, "\u3000" * 3000 + "x" + "=" * 100_000, "'" * 5000 + "s"]
    texts += ["".join(rng.choice("абвгде жз., ") for _ in range(20_000)), "".join(rng.choice(cjk[:300] + "。,、12|'s<|endoftext|> ") for _ in range(50_000)), "<|endoftext|>" * 3000]
    for x in texts:
        got = bpe.assemble(bpe.RANKS, bpe.chunks(x.encode()), {})
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids
        assert bpe.decode(bpe.RANKS, got) == t.decode(got.tolist(), skip_special_tokens=False)


def test_bpe_reuses_chunks_of_all_scripts():
    """Chunks of Cyrillic and CJK texts have sure boundaries, and what lies between is used as it was encoded."""
    rng = random.Random(6)
    word = lambda low, high: "".join(chr(rng.randrange(low, high)) for _ in range(rng.randrange(2, 9)))
    cyrillic = " ".join(word(0x430, 0x450) for _ in range(20_000))
    cjk = "".join(word(0x4E00, 0x9000) + rng.choice("、。") for _ in range(20_000))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (cyrillic, cjk):
        parts = bpe.chunks(text.encode())
        known = {k: bpe.encode_chunk(bpe.RANKS, c) for k, c in enumerate(parts)}
        used = sum(known[k][1] - known[k][0] for k in known if known[k][0] < known[k][1])
        assert used > 0.9 * len(text.encode())
        assert bpe.assemble(bpe.RANKS, parts, known).tolist() == t.encode(text, add_special_tokens=False).ids


# 7 packing -----------------------------------------------------------------------------


def test_packing(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.packed(docs).collect()
    expected = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected += [(r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(expected, key=repr)
    check_places(rows)
    assert packing.packed(docs.limit(0)).count() == 0


def check_places(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_is_tight(spark):
    rows = packing.op7_packing(spark, f"{DATA}/sf0.01").collect()
    assert check_places(rows) <= 1.02 * math.ceil(sum(r.length for r in rows) / 2048)


def test_word_tokens_equal_the_tokenizers():
    t = Tokenizer.from_file(packing.VOCABULARY)
    odd = ["don't Stop's. <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "İstanbul ŉ ß ẞ ΑΣ Σας ſ", "été   a b \u0085 Å", "x'S. 'tis 'll l'l 12a3 é.é", "", "\0a a\0 \0", "ª º µ ĸ", "漢字。🙂🙂 a🙂", "A-b.c,,, !!! $$$"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokens(packing.VOCABULARY).ids(odd)] == [e.ids for e in t.encode_batch(odd, add_special_tokens=False)]


# 8 top-k ---------------------------------------------------------------------------------


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "_TILE", 16)
    centres = rng.normal(size=(5, 6))
    vectors = [(centres[i % 5] + rng.normal(scale=0.05, size=6)).round(2).tolist() for i in range(300)]
    rows = [*enumerate(vectors), (300, vectors[0]), (301, None), (302, [math.nan] * 6), (303, [None] * 6), (305, [math.inf] * 6), (None, vectors[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df, df.vec_id % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    known = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows[:301]}
    expected = []
    for q in sorted(i for i in known if i % 20 == 0):
        best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:20]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == expected
    assert topk.search(df.limit(0), df.vec_id % 20 == 0).count() == 0
    tried = {r.query_id: r.evaluated for r in topk.evaluated(df, df.vec_id % 20 == 0).collect()}
    assert set(tried) == {q for q in known if q % 20 == 0} and all(20 <= n < 200 for n in tried.values())  # of 300; a cluster has 60


def test_topk_of_odd_rows(spark):
    """Repeated ids and rows, vectors of unequal length and empty ones, fewer rows than k."""
    rows = [(0, [1.0, 2.0]), (0, [0.5]), (1, [3.0, 1.0, 5.0]), (1, [3.0, 1.0, 5.0]), (2, []), (3, [-1.0, -1.0]), (20, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
    expected = []
    for q in (0, 20):
        asked = min((e for i, e in v if i == q), key=lambda e: e)
        found = sorted((-sum(a * b for a, b in zip(asked, e)), i) for i, e in v if i != q)
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(found[:20], 1)]
    got = topk.search(df, df.vec_id % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == expected


# 9 secrets -------------------------------------------------------------------------------


def test_secrets(docs, texts_of):
    pattern = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password", "(?i:password").replace("key)", "key))"), re.A), 2, 12),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
    }
    got = {(r.doc_id, r.text): [(s.name, s.start, s.end) for s in r.base_spans] for r in secrets.scan(docs).collect()}
    for i, t in texts_of:
        spans = [(k, m.start(), m.end()) for k, (p, g, n) in pattern.items() for m in p.finditer(t or "") if len(m[g]) >= n]
        assert got[i, t] == sorted(spans, key=lambda s: (s[1], list(pattern).index(s[0])))
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert "abcdEFGH" not in masked[10] and "AKIA" not in masked[10] and masked[4] == dict(texts_of)[4] and masked[0] is None
    assert secrets.redact(docs).columns == docs.columns and secrets.scan(docs.limit(0)).count() == 0


def test_secret_entropy_by_windows(spark):
    """Spans of entropy from windows counted afresh; letters alone count if they mix cases."""
    rng = random.Random(8)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    runs = ["".join(rng.choices(base64, k=rng.randrange(18, 60))) for _ in range(60)] + ["".join(rng.choices("abAB12", k=40)) for _ in range(10)]
    runs += ["".join(rng.choices(base64[:52], k=30)) for _ in range(10)] + ["".join(rng.choices(base64[26:52], k=40)) for _ in range(5)] + ["".join(rng.choices("0123456789ABCDEF", k=rng.randrange(16, 40))) for _ in range(20)]
    texts = [f"see {r}, and" for r in runs]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    some = 0
    for r in found:
        expected = [(s.start, s.end, s.name) for s in r.base_spans]
        base, taken = list(expected), []
        for c in secrets.CLASSES:
            for m in re.finditer(f"[{c.chars}]{{{c.window},}}", r.text):
                v = m[0]
                if re.search(secrets.ALLOW, v) or any(a < m.end() and m.start() < z for a, z, _ in base) or not (re.search("[A-Za-z]", v) and (re.search("[0-9]", v) or v.lower() != v != v.upper())):
                    continue
                hits = [k for k in range(len(v) - c.window + 1) if round(-sum(n / c.window * math.log2(n / c.window) for n in Counter(v[k : k + c.window]).values()), 9) >= c.bits]
                if hits:
                    span = (m.start() + hits[0], m.start() + hits[-1] + c.window, c.kind)
                    if not any(a < span[1] and span[0] < z for a, z, _ in taken):
                        taken.append(span)
        if any(re.search(secrets.ALLOW, r.text[a:z]) for a, z, _ in taken) or base:
            continue  # parts of runs: tested elsewhere
        assert sorted((s.start, s.end, s.name) for s in r.spans) == sorted(taken)
        some += bool(taken)
    assert some > 40


# 10 near duplicates -----------------------------------------------------------------------


def plain_print(text):
    w = words(lower(text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, distance=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = list(root)
    for k, a in enumerate(ps):
        for b in ps[:k]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_simhash(spark, docs):
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, plain_print(r.text)) for r in df.select("doc_id", "text").collect()]
        root = brute_classes({p for _, p in rows})
        least = {}
        for i, p in rows:
            if i is not None:
                least[root[p]] = min(i, least.get(root[p], i))
        got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.classes(df).collect()), key=repr)
        assert got == sorted(((i, p, least.get(root[p])) for i, p in rows), key=repr)
    assert simhash.classes(docs.limit(0)).count() == simhash.unique(docs.limit(0)).count() == 0


def test_links_of_hot_blocks(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)}
    root = brute_classes(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.components(simhash.links(df, small=4)).collect()}
    groups = lambda m: {frozenset(p for p in prints if m(p) == r) for r in set(map(m, prints))}
    assert groups(lambda p: found.get(p, p)) == groups(lambda p: root[p])


def test_unique_keeps_one_of_each(docs):
    kept = simhash.unique(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 1 and 8 not in ids and 7 in ids


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    df = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components.components(df).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_secrets_beside_allowed_words_and_matches(spark):
    key, digest = "q7Rz/Kp2mWx9Lt4Vb8Nc1Hd6Yg3Js5Fa0TeUoQiZ", "9f86d081884c7d65"
    mixed = "A1B9C3D7E5F0A8B2" + "c4d6e8f0a1b3c5d7e9f2"
    texts = [f"see example-repo/{key} now", f"at {digest}/{key} now", f"hex {mixed} now", f"both 0000{key}=xxxx{key} now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert not any(key[k : k + 20] in t for t in got.values() for k in range(len(key) - 19))
    assert "example" in got[0] and got[0].endswith(" now") and got[2].replace(secrets.MASK, "") == "hex  now"
    assert digest not in got[1] and got[3].count(secrets.MASK) == 2


def test_unique_links_similar_texts(spark):
    """Edited copies of similarity 0.8 or more go, whatever their fingerprints; less similar ones stay."""
    rng = random.Random(13)
    rows, expected = [], set()
    for i in range(60):
        words_ = [f"w{rng.randrange(99999)}" for _ in range(200)]
        rows.append((10 * i, " ".join(words_)))
        for k, edits in ((1, 3), (2, 12)):
            new = list(words_)
            for at in range(edits):
                new[at * 15 + 7] = f"x{rng.randrange(99999)}"
            rows.append((10 * i + k, " ".join(new)))
        expected |= {10 * i, 10 * i + 2}
    hot = [f"h{k}" for k in range(300)]
    rows += [(10_000 + i, " ".join(hot) + f" end{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r[0]: simhash.shingles(r[1]) for r in rows}
    jaccard = lambda a, b: len(np.intersect1d(first[a], first[b])) / len(np.union1d(first[a], first[b]))
    assert all(jaccard(10 * i, 10 * i + 1) >= 0.8 > jaccard(10 * i, 10 * i + 2) for i in range(60))
    assert {r.doc_id for r in simhash.unique(df).collect()} == expected | {10_000}


def near_copies(n, edits, seed, words=300):
    rng = random.Random(seed)
    base, out = [f"w{rng.randrange(10**6)}" for _ in range(words)], []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def removed_by_all_pairs(texts):
    """How many texts go if one of each component of links stays: similarity 0.8 or more, or fingerprints within two bits. All pairs, by slabs."""
    found = {x.tobytes(): (x, simhash.fingerprint(t, 5)) for t in texts for x in [simhash.shingles(t)]}
    sets, prints = [x for x, _ in found.values()], np.array([p for _, p in found.values()], np.uint64)
    n, sizes = len(sets), np.array([len(x) for x in sets], np.float32)
    of = np.repeat(np.arange(n), sizes.astype(int))
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(counts > 1) - 1)[code]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int((counts > 1).sum()), 8192):
        here = (counts[code] > 1) & (column >= a) & (column < a + 8192)
        table = np.zeros((n, 8192), np.float32)
        table[of[here], column[here] - a] = 1
        both += table @ table.T
    linked = both >= 0.8 * (sizes[:, None] + sizes - both)
    linked |= np.bitwise_count(prints[:, None] ^ prints) <= 2
    left, components = np.ones(n, bool), 0
    while left.any():
        components += 1
        reach = np.zeros(n, bool)
        reach[left.argmax()] = True
        while True:
            more = reach | linked[reach].any(axis=0)
            if (more == reach).all():
                break
            reach = more
        left &= ~reach
    return len(texts) - components


@pytest.mark.parametrize("n", [500, 5000])
def test_large_groups_of_near_copies(spark, n, monkeypatch):
    """Three seeds, spread around 0.8: of what all pairs would remove at least 99 %, and never more."""
    groups = [near_copies(n, edits, seed) for seed, edits in ((1, 7), (2, 5), (3, 9))]
    if n == 500:
        monkeypatch.setattr(simhash, "BLOCK", 256)  # so that these are beyond a block, too
    df = spark.createDataFrame([(1000 * n * g + i, t) for g, texts in enumerate(groups) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = [r.doc_id // (1000 * n) for r in simhash.unique(df).select("doc_id").collect()]
    for g, texts in enumerate(groups):
        expected = removed_by_all_pairs(texts)
        assert 0.99 * expected <= len(texts) - kept.count(g) <= expected, (g, expected, len(texts) - kept.count(g))


def test_links_of_a_block():
    rng = np.random.default_rng(4)
    base = np.arange(100)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 100)], rng.integers(1000, 1100, rng.integers(0, 30))])).astype(np.uint64) for _ in range(80)]
    sets += [np.array([7], np.uint64), np.array([7], np.uint64), np.array([], np.uint64)]
    true = {(i, j) for i in range(len(sets)) for j in range(i) if (b := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - b) and b}
    found = {(max(p), min(p)) for p in simhash.block_links(sets, 0.8)}
    assert found <= true

    def parts(links):
        root = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(found) == parts(true)


def test_maxent_takes_a_batch_by_slices(monkeypatch):
    """Slices are whole texts of bounded size, and scores don't depend on them."""
    monkeypatch.setattr(maxent_lm, "SLICE", 10)
    sizes = np.array([4, 6, 1, 25, 3, 3])
    assert list(maxent_lm.slices(sizes)) == [(0, 2, 0, 10), (2, 3, 10, 11), (3, 4, 11, 36), (4, 6, 36, 42)]
    assert list(maxent_lm.slices(sizes[:0])) == []
    rng = np.random.default_rng(3)
    counts, tokens = np.array([6, 3, 1, 0, 5]), rng.integers(0, 5, sizes.sum())
    hashes = maxent_lm.word_hashes([b"", b"a", b"b", b"c", b"d"])
    facts = maxent_lm.Vocabulary(15, 5, np.zeros(maxent_lm.CLASSES**maxent_lm.LEVELS), -0.1, -0.2)
    weights = rng.normal(size=(1 << 8, maxent_lm.CLASSES)).astype(np.float32)
    parts = [maxent_lm.score_batch(weights, facts, sizes[a:b], tokens[low:high], hashes, counts, maxent_lm.words(facts, hashes, counts)) for a, b, low, high in maxent_lm.slices(sizes)]
    assert np.concatenate(parts).tolist() == maxent_lm.score_batch(weights, facts, sizes, tokens, hashes, counts).tolist()


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Groups beyond a block that no further band parts, cut by hashes: chains of edits are linked as by all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 1)
    monkeypatch.setattr(simhash, "PAIRS", 1)  # so that no small group makes up for it
    monkeypatch.setattr(simhash, "TURNS", ())
    # Each text lacks other words of its end than its neighbours, so only neighbours are similar.
    stem = [f"w{k}" for k in range(120)]
    texts = [" ".join(stem + [f"t{k}" for k in range(6 * i, 6 * i + 30)]) for i in range(8)]
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    similar = [(i, j) for i in range(8) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 7 <= len(similar) < 28
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = components.components(simhash.similar(rows, "text", 5, 0.8))
    assert found.count() == 8 and found.select("root").distinct().count() == 1
