import random
import re
from collections import defaultdict

from helpers import DATA

from attestra.llm import pii

KEY = b"k"


def test_formats():
    text = "Mail Ann.Lee9@Mail.example.com or ann.lee9@mail.example.com, call +1 (476) 555-6291, card 4111 1111 1111 1111, 5295745161764470, ip 10.2.133.7, GB82 WEST 1234 5698 7654 32. Frau Anna SCHMIDT met Herr Schmidt and Господин Иван Петров. 123-45-6789"
    spans = pii.detect(text)
    kinds = [s[2] for s in spans]
    assert kinds == ["email", "email", "phone", "card", "card", "ip", "iban", "name:latin:f", "name:latin:family", "name:latin:family", "name:cyrillic:m", "name:cyrillic:family", "ssn"]
    assert spans[0][3] == spans[1][3] and spans[8][3] == spans[9][3]
    shown = [pii.render(text[a:b], k, pii.surrogate(KEY, k, v)) for a, b, k, v in spans]
    assert shown[2].startswith("+1 (") and len(shown[2]) == len("+1 (476) 555-6291") and shown[2] != "+1 (476) 555-6291"
    assert pii._luhn(shown[3].replace(" ", "")) == 0 and (pii._luhn(shown[4]) == 0) == (pii._luhn("5295745161764470") == 0) and shown[3].count(" ") == 3
    assert [len(x) for x in shown[5].split(".")] == [2, 1, 3, 1]
    iban = shown[6].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "GB"
    assert shown[7].endswith("ia") and shown[8].isupper() and shown[9] == shown[8].capitalize() and shown[10][0].isupper() and "а" <= shown[10][1] <= "я"
    assert all(pii.surrogate(KEY, k, v) != pii.surrogate(b"other", k, v) and pii.surrogate(KEY, k, v) != v for _, _, k, v in spans)
    assert pii.detect(None) == pii.detect("") == pii.detect("Clean prose, 1999-2024, version 1.2.3, Mr and Mrs.") == []


def test_clean_texts_stay_and_entities_go(spark, docs):
    out = pii.pseudonymise(docs, KEY)
    assert out.columns == [*docs.columns, "n_entities"]
    key = lambda r: repr((r.doc_id, r.text))
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0
    documents = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in documents.collect()}
    mapped = defaultdict(set)
    real = {(k, v) for t in before.values() for _, _, k, v in pii.detect(t)}
    for r in pii.op5_pii(spark, f"{DATA}/sf0.01").collect():
        old = pii.detect(before[r.doc_id])
        assert r.n_entities == len(old) and (old or r.text == before[r.doc_id])
        new = pii.detect(r.text)
        assert [s[2] for s in new] == [s[2] for s in old]
        for a, b in zip(old, new):
            mapped[a[2], a[3]].add(b[3])
            assert (b[2], b[3]) not in real
    assert all(len(x) == 1 for x in mapped.values())
    assert len({(k[0], *v) for k, v in mapped.items()}) == len(mapped) > 20


def test_collisions_are_drawn_anew(spark):
    """Addresses of single digits leave few surrogates, so many collide at first."""
    texts = [".".join(str(n)) for n in range(1111, 9999) if "0" not in str(n)][:400]
    first = [pii.surrogate(KEY, "ip", t) for t in texts]
    assert len(set(first)) < len(first) and set(first) & set(texts)
    rows = pii.surrogates(spark.createDataFrame([("ip", t) for t in texts], "kind string, value string"), KEY).collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 400 and not {r.surrogate for r in rows} & set(texts)


def test_later_mentions_and_one_gender(spark):
    text = "Dr Jane Smith met Mr O'Brien. Smith said that SMITH's aide, jane, and O'Brien-Smith left; Smithson and Janet stayed."
    rows = [(1, text), (2, "Ms Jane Smith wrote to Dr Smith's office."), (3, "Smith and Jane are untitled here.")]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    words = out[1].text.replace(".", " ").replace(";", " ").replace(",", " ").split()
    jane, smith, brien = words[1], words[2], words[5]
    expected = "Dr J S met Mr B. S said that U's aide, j, and B-S left; Smithson and Janet stayed."
    for a, b in (("J", jane), ("S", smith), ("B", brien), ("U", smith.upper()), ("j", jane.lower())):
        expected = " ".join(re.sub(rf"(?<!\w){a}(?!\w)", b, w) for w in expected.split(" "))
    assert out[1].text == expected and out[1].n_entities == 8
    assert out[2].text == f"Ms {jane} {smith} wrote to Dr {smith}'s office." and jane.endswith("ia")
    assert out[3].text == rows[2][1]


def test_names_collide_across_kinds(spark):
    rows = [(k, v) for k in ("name:latin:m", "name:latin:family", "name:latin:n", "name:latin:f") for v in (f"x{i}" for i in range(3000))]
    made = [pii.surrogate(KEY, k, v) for k, v in rows]
    across = {s for k, s in zip(rows, made) if k[0].endswith("family")} & {s for k, s in zip(rows, made) if not k[0].endswith("family")}
    assert across
    found = pii.surrogates(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()
    assert len({r.surrogate for r in found}) == len(found) == len(rows)


def test_kinds_without_free_surrogates_are_masked(spark):
    """Values of a kind that outnumber its surrogates: most get distinct ones, the others asterisks; nothing stays in clear."""
    values = [("phone", f"+1{n:04d}") for n in range(6000)] + [("ip", "8.8.8.8")]
    df = spark.createDataFrame(values, "kind string, value string")
    got = {(r.kind, r.value): r.surrogate for r in pii.surrogates(df, b"k", rounds=4).collect()}
    assert set(got) == set(values)
    drawn = [s for s in got.values() if "*" not in s]
    assert len(drawn) == len(set(drawn)) > 1000 and not set(drawn) & {v for _, v in values}
    assert {s for s in got.values() if "*" in s} == {"+*****"} and pii.render("+1 23 45", "phone", "+*****") == "+* ** **"


def test_ordinary_words_are_no_names():
    shown = lambda t: [(t[a:b], k) for a, b, k, _ in pii.detect(t)]
    assert shown("I saw the Dr. The clinic was closed and the door shut, then the rain") == []
    assert shown("Mr Will May said he will go. It may rain. Will it? Then Will left.") == [("Will", "name:latin:m"), ("May", "name:latin:family"), ("Will", "name:latin:m")]
    assert shown("Monsieur Le Blanc a vu le chat. Le chat dort; le blanc aussi.") == [("Le", "name:latin:m"), ("Blanc", "name:latin:family"), ("blanc", "name:latin:family")]
    assert shown("Mr John Smith came. Mr John left, and so did Mr Smith.") == [("John", "name:latin:m"), ("Smith", "name:latin:family"), ("John", "name:latin:m"), ("Smith", "name:latin:family")]
    assert shown("Mr John left. Mr John Smith came.") == [("John", "name:latin:m"), ("John", "name:latin:m"), ("Smith", "name:latin:family")]


def test_spans_of_generated_texts():
    """Texts built of known pieces: the spans are those of the pieces, whatever stands around them."""
    rng = random.Random(17)
    given, family, filler = ["Anna", "Bela", "Carl", "Dora"], ["Kovač", "Stein", "Moreau", "O'Neil"], ["walked", "home", "slowly", "the", "and", "rain", "over", "green"]
    for _ in range(200):
        text, spans, known = "", [], {}

        def put(piece: str) -> None:
            nonlocal text
            text += ("" if not text else " ") + piece

        def name(word: str, kind: str) -> None:
            put(word)
            spans.append((len(text) - len(word), len(text), word.casefold()))
            known.setdefault(word, kind)

        for _ in range(rng.randrange(1, 25)):
            match rng.randrange(5):
                case 0:
                    put(rng.choice(["Mr", "Frau", "Dr", "Señora"]))
                    name(rng.choice(given), "given")
                    name(rng.choice(family), "family")
                    put(rng.choice(filler))
                case 1 if known:
                    word = rng.choice(list(known))
                    name(rng.choice([word, word.upper(), word.lower()]), "")
                    put(rng.choice(filler))
                case 2:
                    put("Mr. The")
                    put(rng.choice(filler))
                case _:
                    put(rng.choice(filler))
        assert [(a, b, v) for a, b, _, v in pii.detect(text)] == spans, text
