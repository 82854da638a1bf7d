"""Raw files and catalog tables to typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_lake.sources.ranges import RANGE, delimited_fields, json_elements
from retail_lake.sources.schemas import FORMATS, SCHEMAS


#: Holds a line whose number of fields is not that of the header; never a column of a table.
BROKEN = "_broken_line"


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    multi_line: bool = False,
    range_size: int = RANGE,
) -> DataFrame:
    """Delimited text with a header, every field as text, empty fields as NULL.

    Columns go by the names in the header, whatever their order and case: those of ``schema``
    first, then what else the file has. A file without a column of the schema is refused, as is
    one whose header differs from that of the first. Quotes inside quoted text are doubled. Line
    breaks inside quotes need ``multi_line``, with which a file is read twice, in ranges of
    ``range_size`` bytes, to find the ends of its records. A line with too few or too many fields is
    kept whole in the column BROKEN.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("encoding", "UTF-8")
    )
    header = reader.option("multiLine", multi_line).csv(path).columns
    by_name = {name.strip().lower(): name for name in header}
    lacking = [f.name for f in schema.fields if f.name.lower() not in by_name]
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    fields = [T.StructField(name, T.StringType()) for name in [*header, BROKEN]]
    lines = (
        reader.schema(T.StructType(fields))
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .csv(path)
    )
    if multi_line:
        records, fits = delimited_fields(spark, path, header, sep, range_size), F.size("fields") == len(header)
        lines = records.select(
            *[F.when(fits, F.nullif(F.get("fields", F.lit(i)), F.lit(""))).alias(name) for i, name in enumerate(header)],
            F.when(~fits, F.col("line")).alias(BROKEN),
        )
    wanted = {by_name[f.name.lower()]: f.name for f in schema.fields}
    surplus = [name for name in header if name not in wanted]
    return lines.select(
        *[F.col(f"`{old}`").alias(new) for old, new in wanted.items()],
        *[F.col(f"`{name}`").alias(name.strip()) for name in surplus],
        BROKEN,
    )


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """The rows of delimited text that fit the schema, typed; ``rejects`` gives the others."""
    return typed(read_delimited(spark, path, schema, sep, multi_line), schema)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def json_text(
    spark: SparkSession, path: str, schema: T.StructType, by_line: bool = False, range_size: int = RANGE
) -> DataFrame:
    """The objects of files that each hold one array, every field as text, as ``read_delimited`` gives them.

    A field that is not there or null is NULL. An element that is no object, is broken or cut off is
    kept whole in the column BROKEN. Files are split over tasks: where ``by_line`` says that each
    object has a line of its own, as any text; else by reading them twice, to find where elements end.
    """
    if by_line:
        element = F.regexp_replace(F.trim("value"), r"^\[|[,\]]$|,\]$", "")
        elements = spark.read.text(path).select(F.trim(element).alias("value")).filter("value <> ''")
    else:
        elements = json_elements(spark, path, range_size)
    fields = T.StructType([T.StructField(name, T.StringType()) for name in [*schema.names, BROKEN]])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    parsed = elements.select("value", F.from_json("value", fields, options).alias("row"))
    whole = F.col("value").startswith("{") & F.col("value").endswith("}") & F.col(f"row.{BROKEN}").isNull()
    return parsed.select(
        *[F.when(whole, F.col("row")[name]).alias(name) for name in schema.names],
        F.when(~whole, F.col("value")).alias(BROKEN),
    )


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of arrays that fit the schema, typed; ``rejects`` of ``json_text`` gives the others."""
    return typed(json_text(spark, path, schema), schema)


def read_json_lines_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same for arrays written with one object per line."""
    return typed(json_text(spark, path, schema, by_line=True), schema)


def read_raw(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A raw file of a known table as text columns."""
    kind = FORMATS.get(table, "csv")
    if kind == "json":
        return json_text(spark, path, SCHEMAS[table])
    return read_delimited(spark, path, SCHEMAS[table], "\t" if kind == "tsv" else ",")


def read_table_file(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The typed rows of a raw file of a known table that fit."""
    return typed(read_raw(spark, table, path), SCHEMAS[table])


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by its name of one to three parts."""
    return spark.table(name)


def json_fields(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Add typed fields of a JSON text; ``fields`` is name -> (path below the root, type).

    Paths may be nested, such as ``a.b[0]``. What is missing or does not fit is NULL.
    """
    parsed = F.try_parse_json(column)
    return df.withColumns(
        {name: F.try_variant_get(parsed, f"$.{path}", kind) for name, (path, kind) in fields.items()}
    )


def _typed_columns(df: DataFrame, schema: T.StructType) -> dict[str, Column]:
    return {f.name: F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields}


def _broken(df: DataFrame) -> Column:
    return F.col(BROKEN).isNotNull() if BROKEN in df.columns else F.lit(False)


def _misfit(field: T.StructField) -> Column:
    """Whether a text is there but not of its type; NULL stays NULL and is fine."""
    return F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull()


def _faulty(df: DataFrame, schema: T.StructType) -> Column:
    bad = _broken(df)
    for f in schema.fields:
        bad = bad | _misfit(f)
    return bad


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to the schema, for the rows in which every field fits; others stay text."""
    surplus = [c for c in df.columns if c not in schema.names and c != BROKEN]
    return df.filter(~_faulty(df, schema)).select(*_typed_columns(df, schema).values(), *surplus)


def rejects(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The text rows that do not fit the schema, with the names of the faulty columns."""
    names = [F.when(_broken(df), "line"), *(F.when(_misfit(f), f.name) for f in schema.fields)]
    return df.filter(_faulty(df, schema)).withColumn("faults", F.concat_ws(",", *names))
