"""Sources and sinks (S1-S8): JSON arrays and JSON lines in, JSON/Parquet out.

Schemas are declared, never inferred from data. Missing paths and malformed lines fail the
job (FAILFAST), like the original reader; the evaluation-set scanner instead turns them into
error rows so one bad set fails alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from marksheet.session import materialized

INSTRUCTION_SCHEMA = "instruction string, input string, output string, answer string, raw_id string, category string"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Driver-side metadata check through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


_STRING = r'"[^"]*("|$)'  # of a text without escapes; a string that is left open goes on to the end


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, text, rest): the records of JSON array files as texts, found by a parallel scan;
    ``rest`` marks what follows a file's last record and is not empty.

    A file is read in pieces that end at ``}``, where alone a record can end, by as many tasks as
    its size asks for. A piece's effect on the scan is a sum: it adds its number of quotes (an odd
    number so far: the piece begins inside a string) and, once that is known, the change of nesting
    outside strings. Both are prefix sums in two levels: over a block's pieces, and over the blocks
    of a file (one row a block). A piece that ends outside strings at the array's own level ends a
    record. Records are put together from their pieces by number."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("no"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes
    pieces = pieces.withColumn("bare", bare).withColumn("quotes", F.length("bare") - F.length(F.translate("bare", '"', "")))
    pieces = materialized(pieces, "json-pieces")
    own = ["file", "block"]
    inner = Window.partitionBy(*own).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(df, col, out):
        """``col`` summed over the file's pieces before each: inside the block, and over the blocks before."""
        blocks = df.groupBy(*own).agg(F.sum(col).alias("_s")).select(*own, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_b"))
        inside = df.withColumn("_i", F.coalesce(F.sum(col).over(inner), F.lit(0)))
        return inside.join(blocks, own).withColumn(out, F.col("_i") + F.col("_b")).drop("_i", "_b")

    # a file's last piece has a closing brace only if the pieces and their braces make up all its bytes;
    # the first tells whether the records stand in an array
    ends = pieces.groupBy("file").agg(F.max(F.struct("block", "no")).alias("last"), F.min_by("value", F.struct("block", "no")).alias("head"),
                                      (F.sum(F.octet_length("value") + 1) <= F.max("bytes")).alias("full"))
    ends = ends.select("file", "last", "full", F.when(F.col("head").rlike(r"^\s*\["), 1).otherwise(0).alias("base"))
    p = before(pieces, "quotes", "quoted").join(ends, "file").withColumn("closes", F.col("full") | (F.struct("block", "no") != F.col("last")))
    open_ = F.col("quoted") % 2 == 1
    outside = F.regexp_replace(F.when(open_, F.concat(F.lit('"'), F.col("bare"))).otherwise(F.col("bare")), _STRING, "")
    p = p.withColumn("outside", outside).withColumn("ended", (F.col("quoted") + F.col("quotes")) % 2 == 0)
    size = lambda chars: F.length("outside") - F.length(F.translate("outside", chars, ""))
    p = p.withColumn("nest", size("{[") - size("]") - (F.col("closes") & F.col("ended")).cast("int"))
    p = before(p.drop("bare", "outside"), "nest", "depth")
    done = F.col("closes") & F.col("ended") & (F.col("depth") + F.col("nest") == F.col("base"))
    p = before(p.withColumn("done", done.cast("int")), "done", "record")
    text = F.concat("value", F.when(F.col("closes"), F.lit("}")).otherwise(F.lit("")))
    whole = p.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "no", text.alias("t")))).alias("x"), F.max("done").alias("complete"))
    joined = F.array_join(F.transform("x", lambda x: x["t"]), "")
    whole = whole.select("file", "record", F.regexp_replace(joined, r"^[\s,]*\[?[\s,]*", "").alias("text"), (F.col("complete") == 0).alias("rest"))
    return whole.where(~F.col("rest") | ~F.col("text").rlike(r"^[\s\]]*$"))


def _parsed(df: DataFrame, schema: str, bad: Column, keep: tuple = ()) -> DataFrame:
    """The fields of ``schema`` from the JSON in ``text``, and ``_bad``."""
    from pyspark.sql.types import StringType, StructField, _parse_datatype_string
    st = _parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    with_bad = st.add(StructField("_corrupt_record", StringType()))
    rows = df.select(*keep, bad.alias("_cut"), F.from_json("text", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("_r"))
    return rows.select(*keep, *[F.col("_r")[n].alias(n) for n in names], (F.col("_cut") | F.col("_r._corrupt_record").isNotNull()).alias("_bad"))


_SCHEME = r"^(\w+):/+"  # file:/x and file:///x are one place


def qualified(spark: SparkSession, path: str) -> str:
    """A path with scheme and host, as ``_metadata.file_path`` has it but for the slashes after the scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(_SCHEME, r"\1:/", fs.makeQualified(p).toUri().toString())


def read_records(spark: SparkSession, path: str, schema: str = INSTRUCTION_SCHEMA, array_file: bool = True) -> DataFrame:
    """JSON array files (``array_file``, see ``array_records``) or a folder/file of JSON lines, with a
    declared schema; a malformed record fails the job."""
    if not array_file:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = read_records_permissive(spark, path, schema)
    names = [c for c in rows.columns if c != "_bad"]
    fail = F.raise_error(F.lit(f"malformed record in {path}"))
    checked = [F.when(F.col("_bad"), fail.cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in names]
    return rows.where(~F.col("_bad") | fail.cast("boolean")).select(*checked)


def read_records_permissive(spark: SparkSession, path: str, schema: str = INSTRUCTION_SCHEMA,
                            array_file: bool = True) -> DataFrame:
    """Like ``read_records`` but a malformed record becomes a row flagged ``_bad`` instead of a
    failed job; the records around it are kept. JSON lines are parsed line by line (blank lines
    skipped)."""
    if array_file:
        rows = array_records(spark, path)
        return _parsed(rows, schema, F.col("rest"))
    return _parsed(spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "text"), schema, F.lit(False))


def scan_instructions(spark: SparkSession, data_dir: str, train_name: str, val_name: str | None = None,
                      schema: str = INSTRUCTION_SCHEMA, array_file: bool = True, ext: str = ".json") -> dict[str, DataFrame]:
    """The train split and, when named, the val split."""
    out = {"train": read_records(spark, f"{data_dir.rstrip('/')}/{train_name}{ext}", schema, array_file)}
    if val_name:
        out["val"] = read_records(spark, f"{data_dir.rstrip('/')}/{val_name}{ext}", schema, array_file)
    return out


def scan_eval_sets(spark: SparkSession, data_dir: str, names: list[str], schema: str = INSTRUCTION_SCHEMA,
                   template: str = "{dir}/{name}.json", array_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """One file (or folder) per dataset name, tagged with ``dataset_name``.

    Returns (records, errors): an absent path becomes an error row instead of an exception,
    and a malformed record becomes a row-level ``error`` (read permissively), so one bad
    dataset fails alone and the others go on (A3). The name list is a handful of literals.
    """
    found, errors = [], []
    for name in names:
        p = template.format(dir=data_dir.rstrip("/"), name=name)
        if path_exists(spark, p):
            found.append((name, p))
        else:
            errors.append((name, f"path not found: {p}"))
    if not found:
        records = spark.createDataFrame([], schema + ", error string, dataset_name string")
    else:
        if array_file:  # one scan of all files; a file's name says which dataset it is
            rows = array_records(spark, [p for _, p in found])
            place = [(name, qualified(spark, p)) for name, p in found]
            at = F.regexp_replace("file", _SCHEME, "$1:/")
            own = F.coalesce(*[F.when((at == p) | at.startswith(p + "/"), F.lit(name)) for name, p in place])
            records = _parsed(rows.withColumn("_name", own), schema, F.col("rest"), ("_name",))
        else:
            records = None
            for name, p in found:
                d = read_records_permissive(spark, p, schema, False).withColumn("_name", F.lit(name))
                records = d if records is None else records.unionByName(d)
        err = F.when(F.col("_bad"), F.concat(F.lit("malformed record in dataset "), F.col("_name")))
        records = records.withColumn("error", err).withColumn("dataset_name", F.col("_name")).drop("_bad", "_name")
    errs = spark.createDataFrame(errors, "dataset_name string, error string")
    return records, errs


def read_jsonl(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", convert_dates: bool = True,
               timestamp_format: str | None = None) -> DataFrame:
    """JSON lines with a declared schema; a missing path or a malformed line fails.

    Chunked reading is the partitioning itself (S4); incremental reading is ``streaming``.
    With ``convert_dates`` off, timestamp fields of the schema are read as strings.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    r = spark.read.option("mode", "FAILFAST").option("encoding", encoding)
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    df = r.schema(schema).json(path)
    if not convert_dates:
        for f in df.schema.fields:
            if isinstance(f.dataType, TimestampType):
                df = df.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return df


def read_jsonl_stream(spark: SparkSession, path: str, schema: str, max_files: int = 16, encoding: str = "UTF-8") -> DataFrame:
    """S4, incremental form: JSON-lines files as they arrive in ``path``, at most ``max_files``
    per micro-batch (bounded chunks), with a declared schema. A malformed line is a row of nulls
    with the line in ``_corrupt_record`` (null otherwise), so that readers can set it apart."""
    return (spark.readStream.schema(schema + ", _corrupt_record string").option("maxFilesPerTrigger", max_files)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("pathGlobFilter", "part-*").option("encoding", encoding).json(path))


def ascii_json(line: Column) -> Column:
    """JSON text with every non-ASCII run as ``\\uXXXX`` escapes of its UTF-16 units."""
    runs = F.regexp_extract_all(line, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), 0)
    escaped = lambda r: F.regexp_replace(F.lower(F.hex(F.encode(r, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x00-\x7F]"), r).otherwise(escaped(r))), "")


def write_jsonl(df: DataFrame, path: str, mode: str = "w", date_format: str = "iso", force_ascii: bool = False) -> None:
    """JSON lines; mode ``w`` (overwrite) or ``a`` (append); dates ISO text or epoch millis.

    Non-ASCII text is written as is (the original default), or with ``force_ascii`` as ``\\uXXXX``
    escapes (code points beyond 16 bits as surrogate pairs).
    """
    if mode not in ("w", "a"):
        raise ValueError("mode must be 'w' (overwrite) or 'a' (append)")
    if date_format not in ("iso", "epoch"):
        raise ValueError("date_format must be 'iso' or 'epoch'")
    out = df
    if date_format == "epoch":
        for f in df.schema.fields:
            if isinstance(f.dataType, TimestampType):
                out = out.withColumn(f.name, F.unix_millis(F.col(f.name)))
    save, stamp = "overwrite" if mode == "w" else "append", "yyyy-MM-dd'T'HH:mm:ss.SSS"
    if force_ascii:
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]), {"timestampFormat": stamp})
        out.select(ascii_json(line).alias("value")).write.mode(save).text(path)
        return
    out.write.mode(save).option("timestampFormat", stamp).json(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Predictions laid out by dataset (partition pruning on read)."""
    df.write.mode("overwrite").partitionBy("dataset_name").format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str, run_stamp: str | None = None) -> None:
    """The (small: one row per dataset) metrics table as one JSON file, with a run stamp."""
    out = metrics.withColumn("run_stamp", F.lit(run_stamp) if run_stamp else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
    out.coalesce(1).write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str, run_stamp: str | None = None) -> None:
    """The one-row summary."""
    write_metrics(summary, path, run_stamp)


def write_history(log: DataFrame, path: str) -> None:
    """Training and evaluation log rows in one table, laid out by ``phase``."""
    from marksheet.operators.score import split_history
    split_history(log).write.mode("overwrite").partitionBy("phase").json(path)
