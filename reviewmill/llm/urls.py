"""URL filters as a sort-merge range join.

A rule (host, path) becomes the canonical key `reversed host # path`, and the
addresses below it are the keys from there to the key's last continuation: an
interval, nested in another or apart from it.  An address asks once for every
host that it belongs to.  Rules and questions are dealt out over blocks of the
key order and swept in that order; the height of the stack of open rules is a
running sum, and its top is the last rule opened at that height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.llm import common

#: Keys looked at, for each block, to find where blocks of about the same size begin.
SAMPLE_PER_BLOCK = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, tail: Column) -> Column:
    """Labels from the top-level domain down, and the path; `#` is in neither."""
    return F.concat(F.array_join(labels, "."), F.lit("#"), tail).cast("binary")


def _reversed_labels(name: Column) -> Column:
    return F.reverse(F.split(name, r"\."))


def _block(key: Column, starts: list[bytes]) -> Column:
    """Number of the block of a key: how many blocks start at or before it, less one.

    Blocks are searched in two steps, each over about the root of their number.
    """
    step = max(1, int(len(starts) ** 0.5))
    rows = [starts[i:i + step] for i in range(0, len(starts), step)]

    def many(values: list[bytes]) -> Column:
        return F.array(*map(F.lit, values)) if values else F.array().cast("array<binary>")

    row = F.size(F.filter(many([r[0] for r in rows]), lambda s: s <= key))
    within = F.array(*(many(r) for r in rows)) if rows else F.array(many([]))
    column = F.size(F.filter(F.get(within, row - 1), lambda s: s <= key))
    return F.when(row == 0, 0).otherwise((row - 1) * step + column)


def _starts(keys: DataFrame, blocks: int) -> list[bytes]:
    """Where to cut the key order: quantiles of a bounded sample, drawn by hash."""
    drawn = keys.orderBy(F.xxhash64("key"), "key").limit(blocks * SAMPLE_PER_BLOCK)
    found = sorted(bytes(r.key) for r in drawn.collect())
    return sorted(set(found[SAMPLE_PER_BLOCK // 2::SAMPLE_PER_BLOCK]))


def _sweep(keys: DataFrame, rules: DataFrame, blocks: int) -> DataFrame:
    """(key, rule, verdict) of the innermost rule around each key; keys without one are left out."""
    starts = _starts(keys, blocks)
    past = F.concat("key", F.lit(b"\xff"))  # no UTF-8 text holds this byte
    spans = rules.select(
        "key", "rule", "verdict", past.alias("past"),
        _block(F.col("key"), starts).alias("first"), _block(past, starts).alias("last"))
    spans = spans.withColumn("block", F.explode(F.sequence("first", "last")))
    # In a later block than its own, a rule is open from the start, outer rules first.
    opened = spans.select(
        "block", F.when(F.col("block") == F.col("first"), F.col("key"))
        .otherwise(F.lit(b"")).alias("place"),
        F.lit(0).alias("kind"), F.col("key").alias("outer"), "rule", "verdict",
        F.lit(1).alias("step"))
    closed = spans.where("block = last").select(
        "block", F.col("past").alias("place"), F.lit(1).alias("kind"), F.col("key").alias("outer"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
        F.lit(-1).alias("step"))
    asked = keys.select(
        _block(F.col("key"), starts).alias("block"), F.col("key").alias("place"),
        F.lit(2).alias("kind"), F.lit(b"").alias("outer"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
        F.lit(0).alias("step"))
    order = ("place", "kind", "outer")
    so_far = Window.partitionBy("block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    at_height = Window.partitionBy("block", "height").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = opened.unionByName(closed).unionByName(asked)
    swept = swept.withColumn("height", F.sum("step").over(so_far)).where("step >= 0 AND height > 0")
    top = F.last(F.when(F.col("kind") == 0, F.struct("rule", "verdict")), ignorenulls=True)
    return (
        swept.withColumn("top", top.over(at_height)).where("kind = 2")
        .select(F.col("place").alias("key"), "top.rule", "top.verdict")
    )


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url",
          blocks: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of every row of `urls`, with host, path, rule and verdict.

    `rules` has host, path and verdict.  A rule fits the addresses of its host and
    of all subdomains whose path starts with the rule's; of several the longest
    wins (host and path together, then host).  A rule given twice with different
    verdicts has the alphabetically last one; a rule without host or path is left
    out.  Where no rule fits, rule is null and the verdict is `default`.  A missing
    address, or one without `://`, has empty host and path and fits no rule.
    Equal addresses are judged once; repeated rows stay repeated.  `keep` must not
    name host, path, rule or verdict.
    """
    if set(keep) & {"host", "path", "rule", "verdict"}:
        raise ValueError("columns to keep must not be called host, path, rule or verdict")
    blocks = blocks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = rules.where("host <> '' AND path IS NOT NULL").select(
        lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    given = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    given = given.select(
        _key(_reversed_labels(F.col("host")), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict",
        F.size(F.split("host", r"\.")).alias("depth"))
    given = common.staged(given, "url-rules")
    depth = given.agg(F.max("depth")).first()[0] or 0  # hosts below this have no rule of their own

    read = urls.select(*keep, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    addresses = read.select("host", "path").where("host <> ''").distinct()
    labels = _reversed_labels(F.col("host"))
    sizes = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1))))
    asked = common.staged(
        addresses.select("host", "path", F.explode(F.transform(
            sizes, lambda n: _key(F.slice(labels, F.lit(1), n), F.col("path")))).alias("key")),
        "url-keys")
    found = _sweep(asked.select("key").distinct(), given, blocks)
    longest = F.max(F.struct(F.length("rule").alias("size"), F.length("key").alias("deep"),
                             "rule", "verdict"))
    name = common.free(read, "best")
    best = asked.join(found, "key").groupBy("host", "path").agg(longest.alias(name))
    return read.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col(name)["rule"].alias("rule"),
        F.coalesce(F.col(name)["verdict"], F.lit(default)).alias("verdict"))
