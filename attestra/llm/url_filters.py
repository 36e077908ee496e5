"""URL filters: allow and block rules over hosts and paths, by a sort-merge range join.

The canonical key of a host is its labels reversed, so a rule's host covers the interval of
keys that start with its own. Rules and urls are sorted together by that key; a sweep keeps the
stack of the rules' hosts whose interval is open, as one slot for each nesting depth: a
host that starts fills the slot of its depth, and slots whose interval has ended no longer
cover the key that is looked up. What a rule allows below a host hangs on the path too, which comes
behind the whole host of a url, so it is no interval of the same order: a second sweep of the
same kind goes over the paths below each open host, with a stack of the open paths.
The longest covering rule wins; of equally long ones (for different hosts) the one with
the longer host. Two verdicts on one rule: block wins.

A sweep is cut by the last label of the hosts, or by the rule's host. Those above a share of all
keys are dealt out by salts, with their rules repeated for each; only the list of those,
at most 4 * shuffle partitions, is broadcast.

Defined results: a null url, or one without ://, has an empty host and path, which no
rule fits; what no rule fits gets the default verdict. Repeated rows come back as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm import common as C

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules) + " AS t(host, path, verdict)")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _with_depth(rules: DataFrame, key: str, prefixes: str) -> DataFrame:
    """rules and depth: how many others' keys start theirs, of the same host if they have paths; prefixes: SQL for a key's proper prefixes."""
    same = ["host"] if "path" in rules.columns else []
    starts = rules.select(*same, key, F.explode(F.expr(prefixes)).alias("outer_key")).where(F.col("outer_key") != F.col(key))
    depth = starts.join(rules.select(*same, F.col(key).alias("outer_key")), [*same, "outer_key"]).groupBy(*same, key).agg(F.count("*").cast("int").alias("depth"))
    return rules.join(depth, [*same, key], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def _hot(rows: DataFrame, part: str) -> DataFrame:
    """(part, salts) of the parts with more than a share of the rows; broadcast."""
    width = C.shuffle_width(rows.sparkSession)
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    total = max(sizes.agg(F.sum("n")).first()[0] or 0, 1)
    return F.broadcast(sizes.where(F.col("n") * 4 * width > total).select(part, F.ceil(F.col("n") * 4 * width / F.lit(total)).cast("int").alias("salts")))


def _sweep(rows: DataFrame, rules: DataFrame, part: str, key: str, depths: int) -> DataFrame:
    """rows and slot0 .. slot<depths - 1>: the rules (structs with their key) that are open there, null if none.

    rules: part, key, depth and rule.
    """
    hot = _hot(rows, part)
    looked_up = rows.join(hot, part, "left").withColumn("salt", F.expr("cast(pmod(xxhash64(id, url), coalesce(salts, 1)) AS int)")).drop("salts")
    opened = rules.join(hot, part, "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")
    events = looked_up.withColumn("looked_up", F.lit(1)).unionByName(opened.withColumn("looked_up", F.lit(0)), allowMissingColumns=True)
    sweep = W.partitionBy(part, "salt").orderBy(key, "looked_up").rowsBetween(W.unboundedPreceding, W.currentRow)
    slots = [F.last(F.when(F.col("depth") == d, F.col("rule")), ignorenulls=True).over(sweep).alias(f"slot{d}") for d in range(depths)]
    swept = events.select("*", *slots).where("looked_up = 1")
    covering = [F.when(F.startswith(F.col(key), F.col(f"slot{d}.key")), F.col(f"slot{d}")).alias(f"slot{d}") for d in range(depths)]
    return swept.select(*rows.columns, *covering)


def classify(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row for each row of urls: id, url, host, path, rule (host and path, or null), verdict."""
    rules = rules.select(F.translate("host", _UP, _LOW).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    reversed_ = F.expr("concat(array_join(reverse(split(host, '[.]')), '.'), '.')")
    top = F.element_at(F.split("host", "[.]"), -1)
    hosts = _with_depth(rules.select("host").distinct().withColumn("key", reversed_), "key", "transform(sequence(1, size(split(host, '[.]'))), n -> concat(array_join(slice(split(key, '[.]'), 1, n - 1), '.'), '.'))")
    paths = _with_depth(rules, "path", "transform(sequence(1, length(path)), n -> substring(path, 1, n - 1))")
    host_depths, path_depths = ((x.agg(F.max("depth")).first()[0] or 0) + 1 for x in (hosts, paths))

    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count("*").cast("int").alias("rows"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("top", top).withColumn("key", reversed_)
    opened = hosts.select(top.alias("top"), "key", "depth", F.struct("key", "host").alias("rule"))
    swept = _sweep(rows, opened, "top", "key", host_depths)
    below = F.array_compact(F.array(*[F.col(f"slot{d}.host") for d in range(host_depths)]))
    probe = C.store(swept.select("id", "url", "rows", "host", "path", F.explode_outer(below).alias("below")), "probe")

    rule = F.struct(F.col("path").alias("key"), "host", "verdict")
    tried = _sweep(probe.where("below IS NOT NULL"), paths.select(F.col("host").alias("below"), "path", "depth", rule.alias("rule")), "below", "path", path_depths)
    best = F.coalesce(*[F.col(f"slot{d}") for d in reversed(range(path_depths))])
    ranked = F.when(
        best.isNotNull(),
        F.struct((F.length(best["host"]) + F.length(best["key"])).alias("size"), F.length(best["host"]).alias("host_size"), F.concat(best["host"], best["key"]).alias("rule"), best["verdict"].alias("verdict")),
    )
    every = tried.select("id", "url", "rows", "host", "path", ranked.alias("ranked")).unionByName(probe.where("below IS NULL").drop("below"), allowMissingColumns=True)
    out = every.groupBy("id", "url").agg(F.max("rows").alias("rows"), F.max("host").alias("host"), F.max("path").alias("path"), F.max("ranked").alias("won"))
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"),
    ).drop("_copy")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    found = classify(C.read(spark, sf_dir, "pages"), rules_frame(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")


ORACLE = (
    r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, rv) AS (VALUES """
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    + """)
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(rv, length(rh || rp)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL"""
)
