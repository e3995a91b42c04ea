"""Required columns, previews, shapes, profiles and record conformance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def preview(df: DataFrame, *order: str, rows: int = 5) -> DataFrame:
    """The first rows in a stated order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(rows)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def profile(df: DataFrame, column: str = "company_name") -> DataFrame:
    """One row: rows and unique values of a column, a missing value counting as one."""
    missing = F.max(F.col(column).isNull().cast("bigint"))
    return df.agg(
        F.count("*").alias("n_rows"),
        (F.count_distinct(column) + F.coalesce(missing, F.lit(0))).alias("n_unique"),
    )


# Names of the types in a message, and the variant types that satisfy them.
_KINDS = {
    T.StringType: ("string", r"^STRING$"),
    T.LongType: ("integer", r"^BIGINT$"),
    T.DoubleType: ("float", r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"),
    T.StructType: ("dict", r"^OBJECT"),
    T.ArrayType: ("list", r"^ARRAY"),
}
_FINDINGS = "array<struct<path:string,error:string>>"


def _findings(
    root: Column, at: str, dtype: T.DataType, nullable: bool, shown: Column
) -> tuple[list[Column], list[Column]]:
    """Checks of the value at a path of `root` and of everything below it.

    Gives single findings, whose error is null where all is well, and arrays of
    findings.  What lies below a missing or mistyped value is missing itself
    and so raises nothing.
    """
    name, accepted = _KINDS[type(dtype)]
    value = root if at == "$" else F.try_variant_get(root, at, "variant")
    null_error = F.lit(None if nullable else "null value not allowed").cast("string")
    error = F.when(F.is_variant_null(value), null_error).when(
        ~F.schema_of_variant(value).rlike(accepted), F.lit(f"must be of {name} type"))
    single, many = [F.struct(shown.alias("path"), error.alias("error"))], []
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            below = _findings(root, f"{at}.{field.name}", field.dataType, field.nullable,
                              F.concat(shown, F.lit(f".{field.name}")))
            single, many = single + below[0], many + below[1]
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(
            F.try_variant_get(root, at, "array<variant>"),
            lambda item, i: _gathered(item, dtype.elementType, F.concat(
                shown, F.lit("["), i.cast("string"), F.lit("]"))),
        )
        many.append(F.coalesce(F.flatten(items), F.array().cast(_FINDINGS)))
    return single, many


def _gathered(root: Column, dtype: T.DataType, shown: Column) -> Column:
    single, many = _findings(root, "$", dtype, False, shown)
    return F.concat(F.array(*single), *many)


def validate_records(
    df: DataFrame, contract: str, record: str = "record", row_id: str = "record_id"
) -> DataFrame:
    """One row per violation: (record id, path, error).

    `contract` is a schema in DDL.  `record` holds JSON text.  Fields may be absent and unknown fields are
    allowed; a null is accepted only where the contract says nullable.
    """
    unreadable = F.array(F.struct(F.lit("$").alias("path"), F.lit("not valid JSON").alias("error")))
    found = F.when(F.col("_value").isNull(), unreadable).otherwise(
        _gathered(F.col("_value"), T.StructType.fromDDL(contract), F.lit("$"))
    )
    return (
        df.select(row_id, F.try_parse_json(record).alias("_value"))
        .select(row_id, F.explode(found).alias("_found"))
        .where("_found.error IS NOT NULL")
        .select(row_id, "_found.path", "_found.error")
    )
