"""Quality rules: base statistics of a text and line frequency across documents.

Lines are normalised (lower case, one blank between words, every digit as 0), hashed,
and counted per host by the distinct documents that hold them. Exact copies are folded first by a
hash of the whole text, so a large group of copies isn't mistaken for boilerplate. Lines
above the host's limit are removed; a document left with too little of its words is rejected.

Defined results: null and empty texts have no words, fail the base rules and stay
without lines. A null host is a host of its own. Repeated rows are judged alike, each
in its own row; the same text under another host is judged by that host. Other columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C

SYMBOLS = "#*$%&|<>"
#: Names that this operator adds start so; clashing input columns are thus unlikely to exist.
_P = "_qr_"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_documents: int = 10  # a line in no more documents of a host than this stays
    max_share_percent: int = 1  # nor is it removed up to this share of the host's documents
    min_left_percent: int = 20  # of a document's words


#: Window positions take the low bits of a sortable key, their hashes the others.
_PLACE = 28


def _window_hash(words: str, i: str) -> str:
    return f"xxhash64(element_at({words}, {i}), element_at({words}, {i} + 1), element_at({words}, {i} + 2))"


def _repeat_words(words: str) -> list[tuple[str, Column]]:
    """Steps to the words covered by 3-word windows that occur at least twice.

    Windows whose hashes agree in their high bits are found by sorting plain longs;
    only those are then grouped by their whole hashes.
    """
    low, p = (1 << _PLACE) - 1, _P
    key = f"({_window_hash(words, 'i')} & {~low}L) | i"
    same = f"shiftright(element_at({p}keys, k + {{}}), {_PLACE}) = shiftright(w, {_PLACE})"
    return [
        (p + "keys", F.expr(f"CASE WHEN size({words}) >= 4 THEN sort_array(transform(sequence(1, size({words}) - 2), i -> {key})) ELSE cast(array() AS array<bigint>) END")),
        (p + "places", F.expr(f"filter({p}keys, (w, k) -> (k > 0 AND {same.format(0)}) OR (k + 1 < size({p}keys) AND {same.format(2)}))")),
        (p + "windows", F.expr(f"array_sort(transform({p}places, w -> named_struct('h', {_window_hash(words, f'cast(w & {low}L AS int)')}, 'i', cast(w & {low}L AS int))))")),
        (
            "n_repeat_words",
            F.expr(f"""aggregate(
                array_sort(transform(filter({p}windows, (w, k) ->
                    (k > 0 AND element_at({p}windows, k).h = w.h) OR
                    (k + 1 < size({p}windows) AND element_at({p}windows, k + 2).h = w.h)), w -> w.i)),
                named_struct('end', 0, 'n', 0L),
                (a, i) -> named_struct('end', i + 3, 'n', a.n + i + 3 - greatest(i, a.end)),
                a -> a.n)"""),
        ),
    ]


def _line_words(line: Column) -> Column:
    return F.filter(F.split(line, f"{C.SPACE}+"), lambda w: w != "")


def _hash(line_words: Column) -> Column:
    """60 bits of the normalised line's md5, so that any SQL engine can compute it."""
    normal = F.translate(F.lower(F.array_join(line_words, " ")), "123456789", "000000000")
    return F.conv(F.substring(F.md5(normal), 1, 15), 16, 10).cast("long")


def statistics(text: Column, limits: Limits = Limits()) -> list[tuple[str, Column]]:
    """Steps (name, expression), each over the ones before it; those named _qr_... are intermediate."""
    t, p = F.coalesce(text, F.lit("")), _P
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        (p + "lines", lines),
        (p + "line_words", F.transform(p + "lines", _line_words)),
        (p + "words", F.flatten(p + "line_words")),
        *_repeat_words(p + "words"),
        ("n_words", F.size(p + "words").cast("long")),
        ("word_chars", F.length(F.array_join(p + "words", "")).cast("long")),
        ("n_symbols", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long")),
        ("n_dup_lines", (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long")),
        ("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))),
        ("lines", F.transform(p + "line_words", lambda x: F.struct(_hash(x).alias("h"), F.size(x).alias("n")))),
    ]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """Stored: id, text_key (the text's hash), host, the base statistics and the lines (hash, words) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    for name, column in statistics(F.col("text"), limits):
        rows = rows.withColumn(name, column)
    return C.store(rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "host", *BASE, "lines"), "measured")


def frequent_lines(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, h) of the lines above their host's limit, by distinct texts."""
    texts = measured.select("host", "text_key", F.array_distinct("lines.h").alias("hs")).dropDuplicates(["host", "text_key"])
    counts = texts.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    sizes = measured.select("host", "text_key").distinct().groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("host_docs"))
    above = counts.where(F.col("n_docs") > limits.min_documents)
    return (
        above.join(sizes, F.col("host").eqNullSafe(F.col("of_host")))
        .where(100 * F.col("n_docs") > limits.max_share_percent * F.col("host_docs"))
        .select("host", "h")
    )


def _removed(measured: DataFrame, limits: Limits) -> DataFrame:
    """The line rows above the limits: id, text_key, host, h, n. A line's rows are dealt out by salts."""
    salts = C.shuffle_width(measured.sparkSession)
    lines = measured.select("id", "text_key", "host", F.inline("lines")).withColumn("salt", C.salt("id", "text_key", into=salts))
    frequent = C.salted(frequent_lines(measured, limits), salts).withColumnRenamed("host", "of_host")
    on = lines["host"].eqNullSafe(F.col("of_host")) & (lines["h"] == frequent["h"]) & (lines["salt"] == frequent["salt"])
    return lines.join(frequent, on).select("id", "text_key", "host", lines["h"], "n")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """A row for each document: id, the base statistics, removed_words, and kept."""
    measured = measure(docs, id_col, text_col, host_col, limits)
    removed = _removed(measured, limits).select("id", "text_key", "host", F.col("n").cast("long").alias("removed"))
    base = measured.select("id", "text_key", "host", *BASE, F.lit(1).alias("rows"))
    both = base.unionByName(removed, allowMissingColumns=True).groupBy("id", "text_key", "host").agg(
        *[F.max(x).alias(x) for x in BASE], F.sum("rows").alias("rows"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed")
    )
    # Repeated rows met in one group: each gets its own share and its own row back.
    both = both.withColumn("removed", (F.col("removed") / F.col("rows")).cast("long"))
    left = (F.col("n_words") - F.col("removed")) * 100 >= limits.min_left_percent * F.col("n_words")
    return both.select(
        F.col("id").alias(id_col), *BASE, F.col("removed").alias("removed_words"), (~F.col("base_failed") & left).alias("kept"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    ).drop("copy")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, without the lines above their host's limit.

    The columns are those of the input; n_chars, if there is one, follows the text.
    """
    names, p = docs.columns, _P
    measured = measure(docs, id_col, text_col, host_col, limits)
    gone = _removed(measured, limits).groupBy("id", "text_key", "host").agg(F.collect_set("h").alias("gone"))
    passed = measured.where(~F.col("base_failed")).select("id", "text_key", "host", "n_words", F.lit(None).cast("array<bigint>").alias("gone"))
    facts = passed.unionByName(gone, allowMissingColumns=True).groupBy("id", "text_key", "host").agg(F.max("n_words").alias(p + "n"), F.first("gone", ignorenulls=True).alias(p + "gone"))
    facts = facts.where(F.col(p + "n").isNotNull()).withColumnsRenamed({"id": p + "id", "text_key": p + "of_key", "host": p + "host"})
    rows = docs.withColumn(p + "key", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    out = rows.join(facts, rows[id_col].eqNullSafe(F.col(p + "id")) & (F.col(p + "key") == F.col(p + "of_key")) & rows[host_col].eqNullSafe(F.col(p + "host")))
    stays = lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(p + "gone", _hash(_line_words(x))))
    text = F.when(F.col(p + "gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(F.split(F.col(text_col), "\n"), stays), "\n"))
    out = out.withColumn(p + "text", text)
    left = F.when(F.col(p + "gone").isNull(), F.col(p + "n")).otherwise(F.size(C.words(F.col(p + "text"))))
    out = out.where(left * 100 >= limits.min_left_percent * F.col(p + "n"))
    new = {text_col: F.col(p + "text"), "n_chars": F.length(p + "text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
pos AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS s FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win WHERE s IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM t),
lw AS (SELECT doc_id, host, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY 1),
h AS (SELECT doc_id, host, ('0x' || substr(md5(translate(lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')), '123456789', '000000000')), 1, 15))::BIGINT AS h,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lw),
f AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT text) AS n_docs FROM h JOIN (SELECT doc_id, text FROM t) USING (doc_id) GROUP BY 1, 2)
      JOIN (SELECT host, count(DISTINCT text) AS host_docs FROM t GROUP BY 1) USING (host) WHERE n_docs > 10 AND 100 * n_docs > host_docs),
g AS (SELECT doc_id, sum(n)::BIGINT AS removed_words FROM h JOIN f USING (host, h) GROUP BY 1),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN g USING (doc_id)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words - removed_words) * 100 >= 20 * n_words AS kept, removed_words FROM c
"""
