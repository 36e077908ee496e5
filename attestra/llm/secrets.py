"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

A pattern's matches are found leftmost first without overlap, and those failing its
length rule are dropped. Beside them, candidate strings of a character class (hex or
base64) are swept by a window: a count for each symbol of the class moves with it, and its
Shannon entropy is kept up to date from the counts of the symbol that enters and the one
that leaves. Where it reaches the class's threshold the string is a finding, from the first
such window to the last. Candidates without a letter, or with letters of one case alone, are suppressed. What an allow-list names and what a pattern
matched is cut out of a candidate, and each part left is swept on its own; a hex string is
swept across patterns' matches, and the finding is what they leave of it.

Positions are code points, the end exclusive. Everything is DataFrame expressions;
nothing is shuffled. Null and empty texts have no findings and stay as they are;
repeated rows are scanned each on its own; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    group: int = 0
    min_length: int = 0


@dataclass(frozen=True)
class CharClass:
    """Candidate strings: runs of the class, of the window's length at least."""

    kind: str
    chars: str
    window: int
    bits: float


_NAMES = "|".join(map(_either, ["password", "passwd", "secret", "token", "api_?key"]))
PATTERNS = (
    Pattern("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A run is matched whole or not at all, so its least length can stand in the pattern.
    Pattern("access", "AKIA[A-Z0-9]{14,}"),
    Pattern("hex", "[0-9a-f]{16,}"),
)
CLASSES = (
    CharClass("entropy_hex", "0-9a-fA-F", 16, 2.9),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 20, 3.7),
)
#: Strings known to be no secrets: placeholders, counting, the alphabet.
ALLOW = r"(?i)example|placeholder|changeme|xxxx|0000|1234567|abcdefg"
MASK = "[SECRET]"
_P = "_ss_"


def _running_sums(array: str) -> str:
    """Running sums of an int array, in blocks so that long arrays aren't copied at each step."""
    block = 128
    inner = f"""aggregate(slice({array}, b * {block} + 1, {block}),
        named_struct('xs', cast(array() AS array<int>), 's', acc.base),
        (u, x) -> named_struct('xs', array_append(u.xs, u.s + x), 's', u.s + x))"""
    return f"""CASE WHEN size({array}) = 0 THEN cast(array() AS array<int>) ELSE
        aggregate(sequence(0, cast((size({array}) - 1) div {block} AS int)),
            named_struct('parts', cast(array() AS array<array<int>>), 'base', 0),
            (acc, b) -> element_at(transform(array({inner}), r ->
                named_struct('parts', array_append(acc.parts, r.xs), 'base', r.s)), 1),
            acc -> flatten(acc.parts)) END"""


def _literal(regex: str) -> str:
    """A regex as a Spark SQL string literal, escapes doubled."""
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(df: DataFrame, text: str, out: str, regex: str, group: int) -> DataFrame:
    """Add out: array of struct(start, size, value) of the matches; null if there are none."""
    pattern = _literal(regex)
    any_match = f"{text} RLIKE {pattern}"
    p = out + "_"
    df = df.withColumn(p + "found", F.expr(any_match))
    df = df.withColumn(p + "all", F.expr(f"CASE WHEN {p}found THEN regexp_extract_all({text}, {pattern}, 0) END"))
    df = df.withColumn(p + "gap", F.expr(f"CASE WHEN {p}found THEN split({text}, {pattern}, -1) END"))
    value = f"regexp_extract_all({text}, {pattern}, {group})" if group else p + "all"
    df = df.withColumn(p + "value", F.expr(f"CASE WHEN {p}found THEN {value} END"))
    df = df.withColumn(p + "step", F.expr(f"transform({p}all, (m, i) -> length(element_at({p}gap, i + 1)) + CASE WHEN i = 0 THEN 0 ELSE length(element_at({p}all, i)) END)"))
    df = df.withColumn(p + "start", F.expr(f"CASE WHEN {p}found THEN {_running_sums(p + 'step')} END"))
    df = df.withColumn(
        out, F.expr(f"transform({p}all, (m, i) -> named_struct('start', element_at({p}start, i + 1), 'size', length(m), 'value', element_at({p}value, i + 1)))")
    )
    return df.drop(*[p + x for x in ("found", "all", "gap", "value", "step", "start")])


def _alphabet(chars: str) -> str:
    """The characters of a class such as a-f0-9_-, each once."""
    out, k = "", 0
    while k < len(chars):
        if chars[k + 1 : k + 2] == "-" and k + 2 < len(chars):
            out += "".join(map(chr, range(ord(chars[k]), ord(chars[k + 2]) + 1)))
            k += 3
        else:
            out += chars[k]
            k += 1
    return out


def _sweep(symbols: int, window: int, bits: float) -> str:
    """Over the symbols' numbers cs: struct(first, last) positions where a window of enough entropy ends; 0: none.

    n holds the window's count of each symbol. f is the sum of n*log2(n) over them; the
    entropy is log2(window) - f / window.
    """
    g = lambda n: f"(CASE WHEN {n} > 1 THEN {n} * log2({n}) ELSE 0D END)"
    # The symbol that leaves goes first, so it isn't counted where the same one enters.
    step = f"""named_struct('into', element_at(cs, i), 'out', CASE WHEN i > {window} THEN element_at(cs, i - {window}) ELSE 0 END)"""
    left = "(CASE WHEN m.out > 0 THEN element_at(a.n, m.out) ELSE 0 END)"
    had = "(element_at(a.n, m.into) - CASE WHEN m.into = m.out THEN 1 ELSE 0 END)"
    moved = f"""named_struct('f', a.f - {g(left)} + {g(f'({left} - 1)')} - {g(had)} + {g(f'({had} + 1)')},
        'n', CASE WHEN m.into = m.out THEN a.n ELSE transform(a.n, (x, k) -> CASE WHEN k + 1 = m.into THEN x + 1 WHEN k + 1 = m.out THEN x - 1 ELSE x END) END)"""
    hit = f"(i >= {window} AND round(log2({window}) - s.f / {window}, 9) >= {bits}D)"
    return f"""aggregate(sequence(1, size(cs)), named_struct('f', 0D, 'n', array_repeat(0, {symbols}), 'first', 0, 'last', 0), (a, i) ->
        element_at(transform(transform(array({step}), m -> {moved}), s -> named_struct('f', s.f, 'n', s.n,
            'first', CASE WHEN a.first = 0 AND {hit} THEN i ELSE a.first END,
            'last', CASE WHEN {hit} THEN i ELSE a.last END)), 1))"""


def _parts(allow: str, cut_base: bool) -> str:
    """The parts of a candidate m as array of struct(start, value): it less what allow names and, if asked for, what base_spans cover."""
    a = _literal(allow)
    hits = "filter(base_spans, b -> b.start < m.start + m.size AND m.start < b.end)"
    blank = f"""CASE WHEN m.value RLIKE {a} THEN element_at(transform(array(regexp_extract_all(m.value, {a}, 0)), n ->
        array_join(transform(split(m.value, {a}, -1), (g, i) -> concat(g, coalesce(repeat(' ', length(get(n, i))), ''))), '')), 1) ELSE m.value END"""
    if cut_base:
        blank = f"""element_at(transform(array(struct({hits} AS hits, {blank} AS v)), x -> CASE WHEN size(x.hits) = 0 THEN x.v ELSE
            array_join(transform(split(x.v, ''), (c, i) -> CASE WHEN exists(x.hits, b -> b.start <= m.start + i AND m.start + i < b.end) THEN ' ' ELSE c END), '') END), 1)"""
    return f"""element_at(transform(array({blank}), v -> CASE WHEN instr(v, ' ') = 0 THEN array(named_struct('start', m.start, 'value', v)) ELSE
        element_at(transform(array(regexp_extract_all(v, '[^ ]+|[ ]+', 0)), parts -> transform(parts, (g, i) ->
            named_struct('start', m.start + aggregate(slice(parts, 1, i), 0, (n, x) -> n + length(x)), 'value', g))), 1) END), 1)"""


def _uncovered(column: str, span) -> str:
    """The spans of a column without what base_spans cover."""
    free = lambda at: f"NOT exists(h, b -> b.start <= {at} AND {at} < b.end)"
    edge = lambda at, end, step: f"filter(sequence(s.start, s.end - 1), {at} -> {free(at)} AND ({at} = {end} OR NOT ({free(f'({at} {step} 1)')})))"
    cut = f"transform(arrays_zip({edge('p', 's.start', '-')} AS a, {edge('q', 's.end - 1', '+')} AS z), e -> {span('e.a', 'e.z + 1')})"
    cut = cut.replace(" AS a,", ",").replace(" AS z)", ")").replace("e.a", "e['0']").replace("e.z", "e['1']")
    hits = "filter(base_spans, b -> b.start < s.end AND s.start < b.end)"
    return f"flatten(transform({column}, s -> element_at(transform(array({hits}), h -> CASE WHEN size(h) = 0 THEN array(s) ELSE {cut} END), 1)))"


def scan(df: DataFrame, text_col: str = "text", patterns=PATTERNS, classes=CLASSES, allow: str = ALLOW) -> DataFrame:
    """df with two more columns, base_spans and spans: arrays of struct(start, kind, end, name) by start, then kind."""
    names = df.columns
    df = df.withColumn(_P + "text", F.coalesce(F.col(text_col), F.lit("")))
    rank = {x.kind: k for k, x in enumerate([*patterns, *classes])}
    span = lambda kind, start, end: f"named_struct('start', {start}, 'kind', {rank[kind]}, 'end', {end}, 'name', '{kind}')"
    empty = "cast(array() AS array<struct<start:int,kind:int,end:int,name:string>>)"
    for x in patterns:
        df = _matches(df, _P + "text", _P + x.kind, x.regex, x.group)
        df = df.withColumn(_P + x.kind, F.expr(f"coalesce(transform(filter({_P}{x.kind}, m -> length(m.value) >= {x.min_length}), m -> {span(x.kind, 'm.start', 'm.start + m.size')}), {empty})"))
    df = df.withColumn("base_spans", F.array_sort(F.concat(*[F.col(_P + x.kind) for x in patterns])))
    for x in classes:
        c = _P + x.kind
        df = _matches(df, _P + "text", c, f"[{x.chars}]{{{x.window},}}", 0)
        hex_only = x.kind == "entropy_hex"
        fits = "m.value RLIKE '[A-Za-z]' AND (m.value RLIKE '[0-9]' OR m.value RLIKE '[a-z]' AND m.value RLIKE '[A-Z]')"
        whole = "NOT exists(base_spans, b -> b.start <= m.start AND m.start + m.size <= b.end)"
        letters = _alphabet(x.chars)
        swept = f"element_at(transform(array(transform(split(m.value, ''), c -> instr('{letters}', c))), cs -> {_sweep(len(letters), x.window, x.bits)}), 1)"
        df = df.withColumn(c, F.expr(f"flatten(transform(filter({c}, m -> {fits} AND {whole}), m -> {_parts(allow, not hex_only)}))"))
        df = df.withColumn(c, F.expr(f"transform(filter({c}, m -> length(m.value) >= {x.window} AND instr(m.value, ' ') = 0), m -> named_struct('start', m.start, 'at', {swept}))"))
        df = df.withColumn(c, F.expr(f"coalesce(transform(filter({c}, m -> m.at.first > 0), m -> {span(x.kind, f'm.start + m.at.first - {x.window}', 'm.start + m.at.last')}), {empty})"))
        if hex_only:
            df = df.withColumn(c, F.expr(_uncovered(c, lambda a, z, kind=x.kind: span(kind, a, z))))
    # A string of both classes is found once, by the first.
    taken = []
    for x in classes:
        c = _P + x.kind
        for y in taken:
            df = df.withColumn(c, F.expr(f"filter({c}, s -> NOT exists({y}, b -> b.start < s.end AND s.start < b.end))"))
        taken.append(c)
    df = df.withColumn("spans", F.array_sort(F.concat("base_spans", *taken)))
    return df.select(*names, "base_spans", "spans")


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The documents with every finding masked; n_chars, if there is one, follows the text."""
    names = docs.columns
    found = scan(docs.select(F.struct("*").alias(_P + "row"), F.col(text_col).alias(_P + "in")), _P + "in")
    t = _P + "in"
    masked = F.expr(f"""
        aggregate(spans, named_struct('at', 0, 'out', cast(array() AS array<string>)),
            (a, s) -> named_struct('at', greatest(a.at, s.end),
                'out', CASE WHEN s.start >= a.at THEN concat(a.out, array(substring({t}, a.at + 1, s.start - a.at), '{mask}')) ELSE a.out END),
            a -> concat(array_join(a.out, ''), substring({t}, a.at + 1, length({t}))))""")
    found = found.withColumn(_P + "new", F.when(F.size("spans") > 0, masked).otherwise(F.col(t)))
    new = {text_col: F.col(_P + "new"), "n_chars": F.when(F.size("spans") > 0, F.length(_P + "new").cast("long")).otherwise(F.col(f"{_P}row.n_chars")) if "n_chars" in names else None}
    return found.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"{_P}row.`{c}`").alias(c) for c in names])


def _joined(spans: str):
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.name, cast(s.start AS string), cast(s.end AS string))), ',')")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["name"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(x.kind).alias(f"n_{x.kind}") for x in PATTERNS],
        F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def _oracle() -> str:
    """The same by SQL: entropies afresh for each window, from its counts."""
    sql = lambda s: "'" + s.replace("'", "''") + "'"

    def matches(name: str, regex: str, group: int) -> str:
        value = f"regexp_extract_all(text, {sql(regex)}, {group})"
        return f"""{name}_m AS (SELECT doc_id, text, regexp_extract_all(text, {sql(regex)}, 0) AS ms, {value} AS vs, string_split_regex(text, {sql(regex)}) AS gs FROM t),
        {name}_r AS (SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM {name}_m),
        {name}_s AS (SELECT doc_id, m, v, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS s FROM {name}_r)"""

    parts = ["t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"]
    for k, x in enumerate(PATTERNS):
        parts.append(matches(x.kind, x.regex, x.group))
        parts.append(f"{x.kind} AS (SELECT doc_id, {k} AS kind, '{x.kind}' AS name, s, s + length(m) AS e FROM {x.kind}_s WHERE length(v) >= {x.min_length})")
    parts.append("base AS (" + " UNION ALL ".join(f"SELECT * FROM {x.kind}" for x in PATTERNS) + ")")
    taken: list[str] = []
    for k, x in enumerate(CLASSES, len(PATTERNS)):
        n = x.kind
        parts.append(matches(n, f"[{x.chars}]{{{x.window},}}", 0))
        parts.append(f"""{n}_c AS (SELECT * FROM {n}_s q WHERE regexp_matches(v, '[A-Za-z]')
            AND (regexp_matches(v, '[0-9]') OR regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')) AND NOT regexp_matches(v, {sql(ALLOW)})
            AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = q.doc_id AND b.s < q.s + length(q.m) AND q.s < b.e)),
        {n}_w AS (SELECT doc_id, s, i, substr(v, i - {x.window} + 1, {x.window}) AS w FROM (SELECT *, unnest(range({x.window}, length(v) + 1)) AS i FROM {n}_c)),
        {n}_p AS (SELECT doc_id, s, i, count(*) AS n FROM (SELECT doc_id, s, i, unnest(string_split(w, '')) AS c FROM {n}_w) GROUP BY doc_id, s, i, c),
        {n}_h AS (SELECT doc_id, s, i FROM {n}_p GROUP BY 1, 2, 3 HAVING round(log2({x.window}) - sum(n * log2(n)) / {x.window}, 9) >= {x.bits}),
        {n}_a AS (SELECT doc_id, {k} AS kind, '{n}' AS name, s + min(i) - {x.window} AS s, s + max(i) AS e FROM {n}_h GROUP BY doc_id, {n}_h.s)""")
        not_taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM {y} b WHERE b.doc_id = q.doc_id AND b.s < q.e AND q.s < b.e)" for y in taken)
        parts.append(f"{n} AS (SELECT * FROM {n}_a q WHERE true{not_taken})")
        taken.append(n)
    parts.append("every AS (SELECT * FROM base" + "".join(f" UNION ALL SELECT * FROM {y}" for y in taken) + ")")
    joined = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    parts.append(f"b AS (SELECT doc_id, {joined} AS spans, " + ", ".join(f"count(*) FILTER (name = '{x.kind}') AS n_{x.kind}" for x in PATTERNS) + " FROM base GROUP BY 1)")
    parts.append(f"a AS (SELECT doc_id, {joined} AS spans FROM every GROUP BY 1)")
    counts = ", ".join(f"coalesce(n_{x.kind}, 0)::BIGINT AS n_{x.kind}" for x in PATTERNS)
    return "WITH " + ",\n".join(parts) + f" SELECT t.doc_id, {counts}, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"


ORACLE = _oracle()
