"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that stand for null in CSV files: fixed values.
NULLS = ("", "null", "NULL", "None", "NA", "N/A")
#: Keys under which a JSON wrapper object may hold its records: fixed values.
WRAPPERS = ("data", "records", "transactions", "items", "results")
_FORMATS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet", "orc": "orc"}


def format_of(path: str) -> str:
    """The format that a path's extension names."""
    kind = _FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path!r}")
    return kind


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, line_breaks: bool = True) -> DataFrame:
    """CSV with a header, quotes and line breaks in quotes; every spelling in ``NULLS`` is null.

    A file with line breaks in quotes is read by one task; without ``line_breaks`` large files are split."""
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.select(*[F.when(F.col(f.name).isin(*NULLS), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or an object that holds one under a key of ``WRAPPERS``."""
    df = spark.read.option("multiLine", True).json(path)
    held = [c for c in WRAPPERS if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
    return df.select(F.inline(held[0])) if held else df


def read_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, blank ones skipped; a file without any record is an error."""
    df = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no records in {path!r}")
    return df


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """By extension, or by ``kind``."""
    kind = _FORMATS[kind] if kind else format_of(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return read_json(spark, path)
    return read_lines(spark, path) if kind == "jsonl" else spark.read.format(kind).load(path)


def round_trip(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Written in a format and read again, with the types that ``df`` had."""
    form = _FORMATS[kind]
    if form == "csv":
        df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        df.write.option("ignoreNullFields", False).format("json" if form == "jsonl" else form).save(path)
    back = spark_read(df.sparkSession, path, form, df.schema)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema])


def spark_read(spark: SparkSession, path: str, form: str, schema: T.StructType) -> DataFrame:
    """A folder of one format, by a known schema."""
    if form == "csv":
        return read_csv(spark, path, schema, line_breaks=False)
    if form == "json":  # files of lines, which Spark writes, are read as such
        return spark.read.schema(schema).json(path)
    return read_lines(spark, path, schema) if form == "jsonl" else spark.read.schema(schema).format(form).load(path)


def write_partitioned(df: DataFrame, path: str, us: str = "us", rows_per_file: int = 100_000) -> None:
    """Snappy parquet by year, month, day and hour of a column of microseconds, or of times.

    Rows are brought together by hour first, large hours in several tasks, so that there are few files for each."""
    ts = F.timestamp_micros(F.col(us)) if isinstance(df.schema[us].dataType, T.LongType) else F.col(us)
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}
    df.withColumns(parts).hint("rebalance", *parts).write.option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").partitionBy(*parts).mode("overwrite").parquet(path)


def read_hours(spark: SparkSession, path: str, first: str, until: str) -> DataFrame:
    """The hours from ``first`` up to, not including, ``until`` of a table by ``write_partitioned``; the conditions are on
    the folders' names, so no other file is read."""
    at = F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0).cast("decimal(8,6)"))
    day = F.make_date("year", "month", "day")
    return spark.read.parquet(path).filter(day.between(F.lit(first[:10]).cast("date"), F.lit(until[:10]).cast("date"))).filter((at >= F.lit(first).cast("timestamp_ntz")) & (at < F.lit(until).cast("timestamp_ntz")))


def detected_schema(df: DataFrame) -> DataFrame:
    """``field``, ``type`` and ``nullable`` (whether a null occurs), from one pass over the rows."""
    kinds = dict(df.dtypes)
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in kinds])
    return nulls.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(k).alias("type"), (F.col(c) > 0).alias("nullable")) for c, k in kinds.items()])))


#: What texts of whole and of other numbers look like: signs, underscores between digits, exponents, nan and infinity.
_WHOLE = r"^\s*[+-]?\d(_?\d)*\s*$"
_NUMBER = r"^\s*[+-]?((\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?|(?i:nan|inf|infinity))\s*$"


def text_type(value: Column) -> Column:
    """``int64``, ``float64``, ``bool`` or ``string`` by what a text holds; ``string`` for null and empty ones."""
    return F.when(value.rlike(_WHOLE), "int64").when(value.rlike(_NUMBER), "float64").when(F.lower(value).isin("true", "false"), "bool").otherwise("string")


def detected_text_types(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``field``, ``type`` and ``filled`` (values that aren't null or empty) of columns of text, from one pass over all rows.

    A field's type is that of its first value, in ``order``, that isn't plain text; plain text if there is none. Only one
    value a task and column is shuffled."""
    found = []
    for c in columns:
        kind = text_type(F.col(c))
        first = F.min_by(F.when(kind != "string", kind), F.when(kind != "string", F.col(order)))
        found.append(F.struct(F.lit(c).alias("field"), F.coalesce(first, F.lit("string")).alias("type"), F.count_if(F.coalesce(F.col(c) != "", F.lit(False))).alias("filled")))
    return rows.agg(F.array(*found).alias("found")).select(F.inline("found"))


def column_differences(have: list[str], want: list[str]) -> tuple[list[str], list[str]]:
    """Wanted columns that are lacking, and columns that are not wanted."""
    return [c for c in want if c not in have], [c for c in have if c not in want]


def put_staged(df: DataFrame, path: str, batch: str) -> None:
    """Gzipped JSON lines with the batch's id and the time of loading."""
    df.withColumns({"_batch_id": F.lit(batch), "_load_timestamp": F.current_timestamp()}).write.option("compression", "gzip").json(path)


def load_staged(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json.gz") -> DataFrame:
    """Files of a stage whose names fit; lines that can't be read are left out."""
    wide = T.StructType([*schema.fields, T.StructField("_batch_id", T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(path).filter("_corrupt_record is null").drop("_corrupt_record")


def copy_into(table: DataFrame, staged: DataFrame) -> DataFrame:
    """``table`` with the staged rows added, matched by column name; other columns of the stage are left out."""
    return table.unionByName(staged.select(*[c for c in staged.columns if c in table.columns]), allowMissingColumns=True)


def decoded(messages: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON messages, with ``_topic``, ``_partition``, ``_offset`` and ``_timestamp``; works on tables and on
    streams. Messages that are no object of the schema's fields are left out."""
    body = F.from_json(F.col("value").cast("string"), schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = messages.select(body.alias("body"), *[F.col(c).alias(f"_{c}") for c in ("topic", "partition", "offset", "timestamp")])
    return rows.filter("body is not null and body._corrupt_record is null").select("body.*", "_topic", "_partition", "_offset", "_timestamp").drop("_corrupt_record")


def replaced(df: DataFrame, path: str) -> DataFrame:
    """``df`` in the place of whatever lay at ``path``, read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV with a header; at most ``limit`` rows if one is given."""
    (df if limit is None else df.limit(limit)).write.option("header", True).mode("overwrite").csv(path)


def quarantine(df: DataFrame, reason: Column, path: str) -> DataFrame:
    """Rows without a reason; those with one are added to the table at ``path`` with ``reason``, ``tries`` and the time."""
    marked = df.withColumn("reason", reason)
    marked.filter("reason is not null").withColumns({"tries": F.lit(0), "quarantined_at": F.current_timestamp()}).write.mode("append").parquet(path)
    return marked.filter("reason is null").drop("reason")


def retried(rows: DataFrame, mended: Column, most: int = 3, days: int = 30) -> DataFrame:
    """``state`` of quarantined rows after another try: purged if older than ``days``, discarded after ``most`` tries, released
    if mended, else kept; each try counts. ``rows`` has ``tries`` and ``age_us``."""
    old, spent = F.col("age_us") > days * 86_400_000_000, F.col("tries") >= most
    state = F.when(old, "purged").when(spent, "discarded").when(mended, "released").otherwise("kept")
    return rows.withColumns({"state": state, "tries": F.when(old | spent, F.col("tries")).otherwise(F.col("tries") + 1)})


def split_quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others; a null verdict doesn't pass."""
    verdict = F.coalesce(ok, F.lit(False))
    return df.filter(verdict), df.filter(~verdict)


def date_dimension(spark: SparkSession, first: str = "2020-01-01", last: str = "2030-12-31") -> DataFrame:
    """A row for each day."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day"))
    return days.select(F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.year("day").alias("year"), F.quarter("day").alias("quarter"), F.month("day").alias("month"), F.weekofyear("day").alias("week"), (F.dayofweek("day") - 1).alias("weekday"), (F.dayofweek("day").isin(1, 7)).alias("is_weekend"))
