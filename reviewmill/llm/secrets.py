"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they stand.  Weak candidates (user names,
opaque strings, endpoints) are reported only within reach of the parts that make
them a credential: an identifier and a secret.  Parts are joined as intervals: in
the order of their places in a text, each part looks at the nearest identifier
and secret on either side, so no pairs are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.llm import common

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    """A pattern of parts; `group` is what has to have `size` characters or more."""

    name: str
    role: str
    pattern: str
    base: bool
    group: int = 0
    size: int = 0
    mixed: bool = False  # needs capital and small letters and digits


#: The base patterns, in the order in which spans at one place are listed.
BASE = (
    Kind("assign", SECRET,
         r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         True, group=2, size=8),
    Kind("access", IDENTIFIER, r"AKIA[A-Z0-9]+", True, size=16),
    Kind("hex", SECRET, r"[0-9a-f]{32,}", True, size=32),
)
WEAK = (
    Kind("user", IDENTIFIER,
         r"(?i:\b(?:user_?name|user|login|client_?id|access_?key_?id))[\"']?\x20*[:=]\x20*[\"']?"
         r"([A-Za-z0-9_.@+-]+)", False, group=1, size=3),
    Kind("opaque", SECRET, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])",
         False, size=20, mixed=True),
    Kind("endpoint", ENDPOINT,
         r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@/-]+",
         False, size=10),
)
KINDS = BASE + WEAK
#: Code points between the parts of one credential, at most.
REACH = 200


def _found(text: Column, number: int, kind: Kind) -> Column:
    """Each match with the number of code points since the one before: pieces lie between matches."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)

    def one(match: Column, at: Column) -> Column:
        value = F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match
        good = F.length(value) >= kind.size
        if kind.mixed:
            good &= match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
        return F.struct(
            F.lit(number).alias("kind"), at.alias("at"),
            F.length(F.get(pieces, at)).alias("gap"), F.length(match).alias("size"),
            good.alias("good"))

    return F.transform(matches, one)


def _parts(text: Column) -> Column:
    """Matches of all kinds; the costlier weak kinds only where there is an identifier."""
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,good:boolean>>")
    identified = F.lit(False)
    for kind in KINDS:
        if kind.role == IDENTIFIER:
            identified |= text.rlike(kind.pattern)

    def of(number: int, kind: Kind) -> Column:
        there = text.rlike(kind.pattern)
        if not kind.base and kind.role != IDENTIFIER:
            there = identified & there
        return F.when(there, _found(text, number, kind)).otherwise(none)

    return F.concat(*(of(n, k) for n, k in enumerate(KINDS)))


def _of_kind(test) -> Column:
    return F.col("kind").isin([n for n, k in enumerate(KINDS) if test(k)])


def spans(hits: DataFrame, reach: int) -> DataFrame:
    """(row, kind, start, end, good) of the strong parts and of the weak parts that are linked."""
    in_kind = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (
        hits.select("row", F.inline("parts")).repartition("row")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_kind))
        .withColumn("start", F.col("end") - F.col("size"))
    )
    by_place = Window.partitionBy("row").orderBy("start", "kind", "end")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    after = by_place.rowsBetween(1, Window.unboundedFollowing)
    base = _of_kind(lambda k: k.base) & F.col("good")

    def near(test) -> Column:
        """A good part of the kinds lies within reach, or is the part itself."""
        there = _of_kind(test) & F.col("good")
        left = F.max(F.when(there, F.col("end"))).over(before)
        right = F.min(F.when(there, F.col("start"))).over(after)
        return there | F.coalesce(F.col("start") - left <= reach, F.lit(False)) | F.coalesce(
            right - F.col("end") <= reach, F.lit(False))

    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"),
                         F.lit(False))
    covered |= F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"),
                          F.lit(False))
    linked = near(lambda k: k.role == IDENTIFIER) & near(lambda k: k.role == SECRET) & ~covered
    return placed.withColumn("linked", linked).select(
        "row", "kind", "start", "end",
        (F.col("good") & (_of_kind(lambda k: k.base) | F.col("linked"))).alias("good"))


def scan(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: spans is an array of (start, end, order, kind, base).

    Places are code points, the end exclusive, in the order of start and then of
    the kinds.  A strong part stays whatever else is found.  A weak part needs an
    identifier and a secret within `reach` code points, itself counted, and must not
    overlap a strong part.  A missing or empty text has no spans; repeated rows give
    repeated results; other columns are left out.

    Texts are read once and not moved; only the places of matches are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = common.staged(
        docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"),
                    _parts(text).alias("parts")), "secret-parts")
    names = F.array(*(F.lit(k.name) for k in KINDS))
    span = F.struct("start", "end", F.col("kind").alias("order"),
                    F.get(names, F.col("kind")).alias("kind"),
                    _of_kind(lambda k: k.base).alias("base"))
    found = spans(hits, reach).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("good"), span)),
                     lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                     .otherwise(a["order"] - b["order"]).cast("int")).alias("spans"))
    some = hits.where("size(parts) > 0").select(id_col, "row").join(found, "row")
    none = F.array().cast(found.schema["spans"].dataType)
    return some.select(id_col, "spans").unionByName(
        hits.where("size(parts) = 0").select(id_col, none.alias("spans")))


def listed(found: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    return F.array_join(F.transform(
        found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _suspect(text: Column) -> Column:
    """The text may hold a span: without a strong part or an identifier there is none."""
    hit = F.lit(False)
    for kind in KINDS:
        if kind.base or kind.role == IDENTIFIER:
            hit |= text.rlike(kind.pattern)
    return F.coalesce(hit, F.lit(False))


def without_secrets(docs: DataFrame, reach: int = REACH, mask: str = "[secret]",
                    text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, every span in a text replaced by `mask`.

    Overlapping spans become one mask.  Only rows that may hold a span are written, with a number
    by which they find their spans, so copies of a text are dealt out like all others.  A
    missing text stays missing; other columns can have any name.
    """
    suspect = _suspect(F.col(text_col))
    row, spans_col, cut_col = (common.free(docs, name) for name in ("_row", "_spans", "_cut"))
    some = common.staged(
        docs.where(suspect).withColumn(row, F.monotonically_increasing_id()), "suspect-texts")
    found = scan(some.select(row, text_col), reach, row, text_col).where("size(spans) > 0")
    found = common.staged(found.withColumnRenamed("spans", spans_col), "secret-spans")
    text, at = F.col(text_col), F.lit(0).cast("bigint")

    def step(state: Column, span: Column) -> Column:
        piece = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        known = (span["end"] <= state["at"]) | (span["start"] < state["at"])
        return F.struct(
            F.when(known, state["out"]).otherwise(F.concat(state["out"], F.array(piece))).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"))

    begin = F.struct(F.array().cast("array<string>").alias("out"), at.alias("at"))
    cut = F.aggregate(F.col(spans_col), begin, step)
    tail = F.substring(text, (F.col(cut_col)["at"] + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(F.col(cut_col)["out"], mask), F.lit(mask), tail)
    joined = some.join(found, row, "left").withColumn(cut_col, cut).select(*(
        F.when(F.col(cut_col).isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(c)
        for c in docs.columns))
    return docs.where(~suspect).unionByName(joined)
