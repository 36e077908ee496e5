"""Personal data: detected entities get surrogates that keep their type, format, script and gender.

Patterns find e-mail addresses, card and account numbers, IP addresses, phone and social
security numbers, and names behind a form of address. Each distinct value of a kind gets
one surrogate from a keyed hash, everywhere (coreference); digits stay digits, separators
and case stay, card numbers pass or fail their checksum as before, account numbers keep country
and a right checksum, names keep script, gender and whether they are given or family names.
Every further mention of a detected name in its document is an entity too, with or without
a form of address and in any case; but a mention of one that is also an ordinary word counts only if it is capitalised within
a sentence, and such a word alone behind a form of address is the next sentence's. A name that a document uses both as
given and as family name is one person's, and given. A given name has one gender in the whole corpus: that of
most of its forms of address that tell one.

Collisions are checked over the whole corpus, those of names over all kinds of names together.
Where two values have one surrogate, all but the least are drawn anew; so are those whose surrogate is
a real value of their kind or one that is already given, until none is left. Only what is drawn anew
is checked again. Values are joined, never collected. Should a kind have no free surrogates
left after ROUNDS rounds, its remaining values are masked by asterisks, which keeps their
format but not their distinctness. Values of more than a share of all spans are dealt out by
salts; the list of those, at most 4 * shuffle partitions, is broadcast.

Defined results: null and empty texts stay as they are; a text without entities is returned
unchanged, and not shuffled. Repeated rows are treated alike, each in its own row. Other columns are
carried along. Positions are code points.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C

#: Forms of address, by the gender that they tell.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Don", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Doña", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "Doctor"],
}
#: Words that are seldom names. In lower case, or where a sentence begins, they mean themselves.
ORDINARY = frozenset("""
a an and are as at be been but by can could did do does for from had has have he her here his how i if in into is it its just may me might more must my no not
now of on one or our out she should so some than that the their them then there they this to too up us was we were what when where which who why will with would yes you your
das dem den der des die ein eine er es im ist mit nicht sich sie und von wie wir zu
al como con de del el ella en es la las lo los muy no para pero por que se si sin su un una y
au aux avec ce ces cette dans de des du elle en est et il ils je la le les mais ne nous on ou par pas pour que qui sa se ses son sur un une vous
""".split())
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PART = re.compile(r"[^\W\d_]+")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: (kind, pattern); where they overlap, the earlier kind wins.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])")),
    ("ip", re.compile(rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])")),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("name", re.compile(r"(?<!\w)(?P<title>" + "|".join(_GENDER) + rf")\.? (?=(?P<names>{_NAME}(?: {_NAME}){{0,2}}))")),
]
_SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"
#: Syllables of made-up names by script, and endings by gender.
_SYLLABLES = {
    "latin": ("ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(), {"m": "n", "f": "ia", "n": "el", "family": "sen"}),
    "cyrillic": ("ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(), {"m": "н", "f": "ия", "n": "ей", "family": "ко"}),
    "greek": ("βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το φα φε φο".split(), {"m": "ος", "f": "ία", "n": "ις", "family": "ίδης"}),
}


# Values ------------------------------------------------------------------------


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c < "԰" else "greek" if "Ͱ" <= c < "Ѐ" else "latin"


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities in order, without overlap; value is what co-referring spellings share."""
    taken: list[tuple[int, int, str, str]] = []
    if not text:
        return taken
    free = bytearray(len(text))

    def add(start: int, end: int, kind: str, value: str) -> None:
        if not any(free[start:end]):
            free[start:end] = b"\1" * (end - start)
            taken.append((start, end, kind, value))

    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            if kind == "name":
                parts = [p for p in re.finditer(_NAME, m["names"])]
                upper = next((k for k, p in enumerate(parts) if not p[0][0].isupper()), len(parts))
                if upper == 1 and parts[0][0].lower() in ORDINARY:  # the title ended a sentence
                    continue
                for k, p in enumerate(parts[:upper]):
                    given = k < upper - 1
                    role = _GENDER[m["title"]] if given else "family"
                    at = m.start("names") + p.start()
                    word = re.sub("['’][sS]$", "", p[0])
                    add(at, at + len(word), f"name:{_script(word)}:{role}", word.casefold())
            elif kind == "email":
                add(m.start(), m.end(), kind, m[0].lower())
            elif kind == "iban":
                add(m.start(), m.end(), kind, m[0].replace(" ", ""))
            elif kind == "ip":
                add(m.start(), m.end(), kind, m[0])
            else:
                add(m.start(), m.end(), kind, ("+" if m[0][0] == "+" else "") + _digits(m[0]))
    # One value is one person's in a document: given, if it is so anywhere, else a family name.
    names: dict[str, str] = {}
    for _, _, kind, value in sorted(taken, key=lambda s: (s[2].endswith(":family"), s[0])):
        if kind.startswith("name:"):
            names.setdefault(value, kind)
    if names:
        taken = [(a, b, names[v] if k.startswith("name:") else k, v) for a, b, k, v in taken]
        for start, end, value in _mentions(text, names):
            if value not in ORDINARY or _amid(text, start, end):
                add(start, end, names[value], value)
    return sorted(taken)


def _amid(text: str, start: int, end: int) -> bool:
    """Whether an ordinary word is written as a name: capitalised within a sentence."""
    before = text[:start].rstrip(" \"'(«„“")
    return text[start].isupper() and (end - start == 1 or text[start + 1 : end].islower()) and bool(before) and before[-1] not in ".!?…:\n\t\r"


def _mentions(text: str, names: dict[str, str]):
    """(start, end, value) of the names among the words of a text and the parts of words joined by hyphens or apostrophes, longest first."""
    for m in _WORD.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
        first = 0
        while first < len(parts):
            start = parts[first][0]
            last = next((k for k in range(len(parts) - 1, first - 1, -1) if text[start : parts[k][1]].casefold() in names), None)
            if last is not None:
                yield start, parts[last][1], text[start : parts[last][1]].casefold()
            first = first + 1 if last is None else last + 1


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10


class _Stream:
    """Keyed numbers for one value and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.pool, self.turn = 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            self.pool = (self.pool << 256) | int.from_bytes(hashlib.sha256(self.seed + self.turn.to_bytes(4, "big")).digest(), "big")
            self.turn += 1
        self.pool, out = divmod(self.pool, n)
        return out

    def like(self, c: str) -> str:
        if "0" <= c <= "9":
            return str(self.below(10))
        if c.isalpha():
            first = "A" if c.isupper() and c.isascii() else "а" if _script(c) == "cyrillic" else "α" if _script(c) == "greek" else "a"
            return chr(ord(first) + self.below(24 if first == "α" else 26))
        return c


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a value, of the same kind and format; another one for each attempt."""
    s = _Stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.partition("@")
        d = _Stream(key, "domain", domain, attempt)
        return "".join(map(s.like, local)) + "@" + "".join(map(d.like, domain.split(".")[0])) + ".example." + ("com", "net", "org")[d.below(3)]
    if kind == "ip":
        low_high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        spans = [low_high[len(o)] if attempt < 16 else (1, 254) for o in value.split(".")]
        return ".".join(str(a + s.below(b - a + 1)) for a, b in spans)
    if kind == "iban":
        body = "".join(map(s.like, value[4:]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind.startswith("name:"):
        _, script, role = kind.split(":")
        syllables, ends = _SYLLABLES[script]
        n = 2 + attempt // 4 + s.below(2)
        return "".join(syllables[s.below(len(syllables))] for _ in range(n)) + ends[role]
    plus = value.startswith("+")
    digits = value.lstrip("+")
    kept = len(digits) - 10 if plus and len(digits) > 10 else 1 if plus else 0  # the country's code stays
    new = digits[:kept] + "".join(str(2 + s.below(8)) if k == 0 else str(s.below(10)) for k in range(len(digits) - kept))
    if kind == "card":
        # The checksum comes out as it was: right stays right, wrong stays wrong.
        right = next(d for d in "0123456789" if _luhn(new[:-1] + d) == 0)
        if _luhn(digits) == 0:
            new = new[:-1] + right
        elif new[-1] == right:
            new = new[:-1] + str((int(right) + 1) % 10)
    return "+" * plus + new


def render(original: str, kind: str, new: str) -> str:
    """The surrogate in the spelling of one occurrence: its separators and case."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if "0" <= c <= "9" else c for c in original)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in original)
    if original.isupper() and len(original) > 1 and kind != "ip":
        return new.upper()
    if kind.startswith("name:") and original[:1].islower():
        return new
    return new[0].upper() + new[1:] if kind.startswith("name:") or original[:1].isupper() else new


# The job -------------------------------------------------------------------------


def scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """Stored: row (the other columns), a number of its own, text, spans."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_pii_")).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k, "value": v} for a, b, k, v in detect(x.as_py())] for x in batch.column(1)]
            numbers = pa.array(range(number, number + len(spans)), pa.int64())
            number += len(spans)
            typed = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers, batch.column(1), pa.array(spans, typed)], ["row", "number", "text", "spans"])

    return C.store(rows.mapInArrow(run, f"row {kind}, number bigint, text string, spans {_SPANS}"), "scanned")


#: Rounds of drawing anew before what is left is masked.
ROUNDS = 64


def one_gender(values: DataFrame) -> DataFrame:
    """(kind, value, drawn) from (kind, value, n): the kind to draw for, with one gender for all kinds of a given name."""
    role, script = F.split_part("kind", F.lit(":"), F.lit(3)), F.split_part("kind", F.lit(":"), F.lit(2))
    given = role.isin("m", "f", "n")
    count = lambda r: F.coalesce(F.sum(F.when(role == r, F.col("n"))), F.lit(0))
    told = values.where(given).groupBy(script.alias("script"), F.col("value").alias("of_value")).agg(count("m").alias("m"), count("f").alias("f"))
    told = told.select("script", "of_value", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > 0, "f").otherwise("n").alias("gender"))
    on = given & (script == F.col("script")) & (F.col("value") == F.col("of_value"))
    return values.join(told, on, "left").select("kind", "value", F.when(F.col("gender").isNull(), F.col("kind")).otherwise(F.concat(F.lit("name:"), "script", F.lit(":"), "gender")).alias("drawn"))


def surrogates(values: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): distinct, and none of them a value itself, but for masked ones."""
    schema = "kind string, value string, attempt int, surrogate string"

    def run(batches):
        for batch in batches:
            kinds, found, attempts = (batch.column(k).to_pylist() for k in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([surrogate(key, k, v, a) for k, v, a in zip(kinds, found, attempts)], pa.string())], ["kind", "value", "attempt", "surrogate"])

    space = F.when(F.col("kind").startswith("name:"), "name").otherwise(F.col("kind"))
    draw = lambda rows: C.store(rows.mapInArrow(run, schema).withColumn("space", space), "surrogates")
    real = values.select(space.alias("space"), F.col("value").alias("surrogate")).distinct()
    fresh, settled = draw(values.select("kind", "value", F.lit(0).alias("attempt"))), []
    for _ in range(rounds):
        taken = fresh.groupBy("space", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("value", "kind")).alias("keeps")).where("n > 1")
        bad = fresh.join(taken, ["space", "surrogate"]).where(F.struct("value", "kind") != F.col("keeps")).select("kind", "value")
        for given in [real, *settled]:
            bad = bad.union(fresh.join(given, ["space", "surrogate"], "left_semi").select("kind", "value"))
        bad = C.store(bad.distinct(), "clashes")
        settled.append(C.store(fresh.join(bad, ["kind", "value"], "left_anti"), "settled"))
        again = fresh.join(bad, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        fresh = draw(again)
        if not bad.take(1):
            break
    masked = fresh.withColumn("surrogate", F.regexp_replace("value", r"[\p{L}\p{N}]", "*"))
    return reduce(DataFrame.unionByName, [*settled, masked]).select("kind", "value", "surrogate")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with its texts' entities replaced, and n_entities (long)."""
    names = [c for c in docs.columns if c != "n_entities"]
    found = scanned(docs, text_col)
    spans = found.where(F.size("spans") > 0)
    asked = spans.select("number", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))).alias("e")).select("number", "e.kind", "e.value")
    values = C.store(asked.groupBy("kind", "value").agg(F.count("*").alias("n")), "values")
    kinds = C.store(one_gender(values), "kinds")
    drawn = surrogates(kinds.select(F.col("drawn").alias("kind"), "value").distinct(), key).withColumnsRenamed({"kind": "drawn", "value": "of_value"})
    chosen = C.store(kinds.join(drawn, (kinds["drawn"] == drawn["drawn"]) & (F.col("value") == F.col("of_value"))).select("kind", "value", "surrogate"), "chosen")
    width = C.shuffle_width(docs.sparkSession)
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(values.where(F.col("n") * 4 * width > total).select("kind", "value", F.ceil(F.col("n") * 4 * width / F.lit(max(total, 1))).cast("int").alias("salts")))
    left = asked.join(hot, ["kind", "value"], "left").withColumn("salt", F.expr("cast(pmod(xxhash64(number), coalesce(salts, 1)) AS int)")).drop("salts")
    right = chosen.join(hot, ["kind", "value"], "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")
    given = left.join(right, ["kind", "value", "salt"]).groupBy("number").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("given"))
    both = spans.join(given, "number").select("row", "text", "spans", "given")
    kind = found.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, spans, given in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                new = {(g["kind"], g["value"]): g["surrogate"] for g in given}
                out, at = [], 0
                for s in spans:
                    out += [text[at : s["start"]], render(text[s["start"] : s["end"]], s["kind"], new[s["kind"], s["value"]])]
                    at = s["end"]
                texts.append("".join([*out, text[at:]]))
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "text", "n_entities"])

    done = both.mapInArrow(run, f"row {kind}, text string, n_entities bigint")
    rest = found.where(F.size("spans") == 0).select("row", "text", F.lit(0).cast("long").alias("n_entities"))
    return rest.unionByName(done).select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names], "n_entities")


#: For the query over the shared tables; elsewhere the key is a secret of its user.
TEST_KEY = b"test key of the shared tables"


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, TEST_KEY).select("doc_id", "text", "n_entities")
