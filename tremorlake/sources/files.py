"""File sources and sinks: discovery by extension, typed reads by column name, processed-table export."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# extension -> (reader format, options)
FORMATS = {
    "csv": ("csv", {"header": "true"}),
    "tsv": ("csv", {"header": "true", "sep": "\t"}),
    "parquet": ("parquet", {}),
    "json": ("json", {}),
}


#: spellings of a missing cell in sensor files
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None")
#: files whose first line is read at the same time
HEADER_READERS = 16
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns is a missing value: NULL."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType)) for c in floating})


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def find_data_files(spark: SparkSession, folder: str) -> list[str]:
    """Tabular files directly in ``folder`` (not recursive), by extension in any case, ordered by extension then name."""
    jpath, fs = _file_system(spark, folder)
    if not fs.exists(jpath):
        return []
    names = [st.getPath().toString() for st in fs.listStatus(jpath) if st.isFile()]
    out = []
    for ext in FORMATS:
        out += sorted(n for n in names if n.lower().endswith("." + ext))
    return out


def _header(spark: SparkSession, path: str, encoding: str) -> str:
    """First line of a file."""
    jvm = spark.sparkContext._jvm
    jpath, fs = _file_system(spark, path)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(jpath), encoding))
    try:
        return lines.readLine() or ""
    finally:
        lines.close()


def _by_header(spark: SparkSession, paths: list[str], encoding: str) -> list[list[str]]:
    """The files in groups of equal first lines; ``HEADER_READERS`` files are open at a time."""
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for p, head in zip(paths, pool.map(lambda p: _header(spark, p, encoding), paths)):
            groups.setdefault(head.lstrip("\ufeff"), []).append(p)
    return list(groups.values())


def _read_csv(spark: SparkSession, paths: list[str], opts: dict, schema: T.StructType | None,
              encoding: str) -> DataFrame:
    """CSV files by column name: files with the same header are one read, the reads are united by name."""
    out = None
    for own in _by_header(spark, paths, encoding):
        reader = spark.read.options(**opts, encoding=encoding)
        d = reader.option("inferSchema", str(schema is None).lower()).csv(own)
        if schema is not None:
            # the same files again with the wanted types, in the order of their header
            typed = T.StructType([schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in d.columns])
            d = reader.schema(typed).csv(own)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_files(spark: SparkSession, paths: list[str], ext: str, schema: T.StructType | None = None,
               encoding: str = "UTF-8") -> DataFrame:
    """The listed files of one kind as one DataFrame; CSV with an explicit schema by name when given, else inferred."""
    fmt, opts = FORMATS[ext]
    if fmt == "csv":
        return nan_to_null(_read_csv(spark, paths, opts, schema, encoding))
    return nan_to_null(spark.read.format(fmt).options(**opts).load(paths))


@dataclass
class CheckedRead:
    """``rows`` in the wanted types, and ``rejected``: file, line (its text) and reasons (column, text, problem)."""

    rows: DataFrame
    rejected: DataFrame


def _cell(c: Column, kind: T.DataType, missing: Column) -> tuple[Column, Column]:
    """A text cell in its type (NULL when missing), and whether it is there but does not parse."""
    text = F.trim(c)
    present = c.isNotNull() & ~F.array_contains(missing, text)
    if isinstance(kind, T.StringType):
        return F.when(present, c), F.lit(False)
    value = text.try_cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # the cast also takes 1d and 1f
        value = F.when(text.rlike(_NUMBER), value)
    return F.when(present, value), present & value.isNull()


def read_csv_checked(spark: SparkSession, paths: list[str], schema: T.StructType, ext: str = "csv",
                     encoding: str = "UTF-8", missing: tuple[str, ...] = MISSING) -> CheckedRead:
    """CSV files by column name, in which no cell turns to NULL unseen.

    Cells are read as text and cast one by one.  A line with a cell that is
    neither missing nor of its column's type, or with more or fewer cells than
    the header, goes whole to ``rejected`` with every reason; all others are
    ``rows``.  Both come from the same scan expression, so each line is in
    exactly one of them.  A byte order mark before the header is no part of
    the first name; a column of ``schema`` that a file lacks is NULL there;
    other columns of the files are left out; blank lines are no lines.
    """
    marks = F.array(*[F.lit(m) for m in missing])
    parsed = None
    for own in _by_header(spark, paths, encoding):
        reader = spark.read.options(**FORMATS[ext][1], encoding=encoding)
        names = [c.lstrip("\ufeff") for c in reader.csv(own[:1]).columns]
        line, path = "__line", "__file"
        texts = T.StructType([T.StructField(c, T.StringType()) for c in [*names, line]])
        # all cells are looked at whatever columns a query asks for
        raw = (reader.schema(texts).options(columnNameOfCorruptRecord=line, columnPruning="false", enforceSchema="true")
               .csv(own).withColumn(path, F.input_file_name()))
        cells = {f.name: _cell(F.col(f"`{f.name}`"), f.dataType, marks) for f in schema.fields if f.name in names}
        reason = lambda col, text, problem: F.struct(col.alias("column"), text.alias("text"),
                                                     problem.alias("problem"))
        reasons = F.filter(F.array(
            F.when(F.col(line).isNotNull(), reason(F.lit(None).cast("string"), F.lit(None).cast("string"),
                                                   F.lit("number of cells"))),
            *[F.when(bad, reason(F.lit(c), F.col(f"`{c}`"), F.lit(f"not a {schema[c].dataType.simpleString()}")))
              for c, (_, bad) in cells.items()]), lambda r: r.isNotNull())
        sep = FORMATS[ext][1].get("sep", ",")
        whole = F.coalesce(F.col(line), F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]))
        values = [(cells[f.name][0] if f.name in cells else F.lit(None).cast(f.dataType)).alias(f.name)
                  for f in schema.fields]
        d = raw.select(F.struct(*values).alias("row"), F.col(path).alias("file"), whole.alias("line"),
                       reasons.alias("reasons"))
        parsed = d if parsed is None else parsed.unionByName(d)
    if parsed is None:
        nothing = T.StructType([T.StructField("row", schema), *[T.StructField(c, T.StringType()) for c in
                                                               ("file", "line")]])
        parsed = spark.createDataFrame([], nothing).withColumn("reasons", F.expr(
            "CAST(array() AS ARRAY<STRUCT<column: STRING, text: STRING, problem: STRING>>)"))
    return CheckedRead(parsed.where(F.size("reasons") == 0).select("row.*"),
                       parsed.where(F.size("reasons") > 0).select("file", "line", "reasons"))


def read_tables(spark: SparkSession, folder: str, schema: T.StructType | None = None,
                encoding: str = "UTF-8") -> DataFrame | None:
    """Every tabular file of the folder, each read with its own format, united by column name."""
    found = find_data_files(spark, folder)
    out = None
    for ext in FORMATS:
        own = [f for f in found if f.lower().endswith("." + ext)]
        if own:
            d = read_files(spark, own, ext, schema, encoding)
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite-write a processed table (parquet by default, CSV with a header row)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
