"""Corpus file formats (S1-S5, S7-S9).  All readers are lazy DataFrame scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CSV_NA_TOKENS
from ..functions.dialogue import parse_dialogue_list, parse_dialogue_text
from ..schemas import PROFILE_ENTRY, RUN_DUMP

TRANSCRIPT_TURN_RE = "(?s)^(Clinician|Client): (.*)$"
NAME_RE = "conversation_profile(\\d+)_(\\d{8}T\\d{6})"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _named(rows: DataFrame, experiment: Column) -> DataFrame:
    """Profile id and timestamp from ``file``, the transcript's path or name."""
    profile, stamp = (F.regexp_extract("file", NAME_RE, i) for i in (1, 2))
    return rows.select(
        "file", experiment.alias("experiment"), F.when(profile != "", profile).cast("int").alias("profile_id"),
        F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd'T'HHmmss")).alias("ts"), "transcript")


def read_transcripts(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """S1 + S2: one row per ``*.txt`` under ``root`` (recursively): file path, experiment
    (parent folder), profile id and timestamp from the file name, and the whole text.
    A missing folder gives an empty frame.  ``packed``: the Parquet layout of ``write_transcripts``, where
    ``file`` is the conversation's name."""
    schema = "file string, experiment string, profile_id int, ts timestamp, transcript string"
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)
    if packed:
        rows = spark.read.schema("conversation string, transcript string, experiment string").parquet(root).withColumnsRenamed(
            {"conversation": "file"})
        return _named(rows, F.col("experiment"))
    raw = (spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true")
           .text(root, wholetext=True)
           .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("transcript")))
    # plain layout: <experiment>/conversation_profile<id>_<stamp>.txt; our writer's
    # layout: experiment=<e>/conversation=conversation_profile<id>_<stamp>/part-*.txt
    parent = F.regexp_extract("file", "([^/]+)/[^/]+$", 1)
    grand = F.regexp_extract("file", "([^/]+)/[^/]+/[^/]+$", 1)
    experiment = F.when(parent.startswith("conversation="), F.regexp_replace(grand, "^experiment=", "")) \
        .otherwise(parent)
    return _named(raw, experiment)


def transcript_turns(docs: DataFrame, text_col: str = "transcript") -> DataFrame:
    """S3: 'Speaker: text\\n\\n' blocks -> turn rows (``turn`` dense from 0, role mapped back)."""
    parts = F.filter(F.split(F.col(text_col), "\n\n"), lambda b: F.trim(b, F.lit("\n")) != "")
    blocks = docs.select("*", F.posexplode(parts).alias("_i", "_b")).drop(text_col)
    spk = F.regexp_extract("_b", TRANSCRIPT_TURN_RE, 1)
    parsed = blocks.withColumn("speaker", F.when(spk != "", spk)) \
        .withColumn("text", F.when(spk != "", F.regexp_extract("_b", TRANSCRIPT_TURN_RE, 2)).otherwise(F.col("_b")))
    role = F.when(F.col("speaker") == "Clinician", "assistant").when(F.col("speaker") == "Client", "user")
    return parsed.withColumn("role", role).withColumn("turn", F.col("_i").cast("long")).drop("_i", "_b")


def file_order(scan: DataFrame, out: str) -> DataFrame:
    """Add ``out``: each row's 0-based position among all rows of a file scan, by file path and then by its
    place in the file, however Spark packs the files into tasks.

    A split is a stretch of one file, read in order by one task, so a row's place in it follows from the
    running id of the task; a prefix sum over the splits (one row each) gives what lies before it."""
    d = scan.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"),
                          "_mid": F.monotonically_increasing_id()})
    splits = d.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_at", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return d.join(splits, ["_file", "_at"]).withColumn(out, F.col("_off") + F.col("_mid")).drop("_file", "_at", "_mid", "_off")


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled dialogue CSV with pandas' default missing-value tokens read as NULL (Q1).

    Every column is read as text; ``utterance_id`` becomes BIGINT; ``input_pos``
    numbers the rows of all files in name order, for ties and for files without ids.
    """
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", "PERMISSIVE").csv(path))
    columns = df.columns
    df = file_order(df, "input_pos")
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isin(*CSV_NA_TOKENS) | F.col(c).isNull(), None)
                           .otherwise(F.col(c)))
    if "utterance_id" in df.columns:
        df = df.withColumn("utterance_id", F.expr("try_cast(try_cast(utterance_id as double) as bigint)"))
    return df.select(*columns, "input_pos")


def read_dialogue_rows(spark: SparkSession, path: str, fmt: str = "json", kind: str | None = None,
                       schema=None) -> DataFrame:
    """S5 + F3 + X2-X4: exported dialogue rows -> ``id, turn, role, text, id_generated``.

    ``dialogue`` may be a string (labels / lines) or a list (``kind`` = map | pair | scalar).
    Pass ``schema`` with ``dialogue ARRAY<MAP<STRING,STRING>>`` to keep each item's own
    keys (and null values); with inferred structs, absent keys and nulls look alike.
    A missing id becomes the row's position among all rows read, files in name order, and only then rows
    without a dialogue are dropped.  ``id_generated`` tells such an id from an equal one in the file.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = file_order(reader.load(path), "_row").filter(F.col("dialogue").isNotNull())
    dtype = df.schema["dialogue"].dataType
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        names = [f.name for f in dtype.elementType.fields]
        as_map = F.transform("dialogue", lambda x: F.map_filter(
            F.create_map(*[e for n in names for e in (F.lit(n), x[n].cast("string"))]),
            lambda k, v: v.isNotNull()))
        df = df.withColumn("dialogue", as_map)
    rid = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"id_generated": rid.isNull(), "id": F.coalesce(rid, F.col("_row").cast("string"))})
    dtype = df.schema["dialogue"].dataType
    if isinstance(dtype, T.StringType):
        turns = parse_dialogue_text("dialogue")
    else:
        turns = parse_dialogue_list("dialogue", kind or ("map" if isinstance(dtype.elementType, T.MapType)
                                                         else "pair" if isinstance(dtype.elementType, T.ArrayType)
                                                         else "scalar"))
    return df.select("id", "id_generated", F.posexplode(turns).alias("turn", "t")).select(
        "id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "id_generated")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of profiles -> ``profile_id`` (array position), profile, cognitive profile."""
    raw = spark.read.text(path, wholetext=True)
    arr = F.from_json("value", T.ArrayType(PROFILE_ENTRY))
    return raw.select(F.posexplode(arr).alias("profile_id", "p")).select(
        F.col("profile_id").cast("int"), "p.profile", F.col("p.`cognitive profile`").alias("cognitive profile"))


def read_run_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Run dump JSON files (multi-line objects) with the declared schema."""
    return spark.read.schema(RUN_DUMP).option("multiLine", True).json(path) \
        .withColumn("file", F.col("_metadata.file_path"))


def read_requests(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Request log, one JSON body per line (validate with ``request_check``); with ``stream`` as a file
    stream over the folder, of ``max_files`` new files a batch."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"))
