"""Tables from files and to files. CSV has a header, UTF-8, quoted line breaks, and "" for a missing string."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}


def scratch_path(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder; in a temporary one only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, for frames with several uses: these neither
    recompute it nor depend on executors that may be lost."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(**CSV).schema(schema).csv(path).na.fill("")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read as text, then cast; what doesn't cast is null."""
    text = read_text_csv(spark, path, [f.name for f in schema])
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema])


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, str]:
    """(table, "found" or "missing"); a missing file gives an empty table."""
    try:
        return spark.read.schema(schema).parquet(path), "found"
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema), "missing"


#: Endings that the line reader takes as packed, and unpacks.
_PACKED = ["gz", "bz2", "zst", "lz4", "snappy", "deflate", "passthrough"]
_PACKED_NAME = rf"\.({'|'.join(_PACKED)})$"


def read_paged_lines(spark: SparkSession, folder: str, name: str, returns: bool = False) -> DataFrame:
    """(file, page, line_no, line) of text files whose name gives the page number. A line ends at a line feed; a carriage return
    before it is no part of the line, unless `returns`.

    Files are read in splits, so none is one value; only the counts of splits meet in a window. The reader drops a byte order
    mark, which the file's size tells, and which is put back."""
    about = {"file": "file_name", "path": "file_path", "size": "file_size", "start": "file_block_start"}
    raw = spark.read.option("lineSep", "\n").text(folder).select(*[F.col(f"_metadata.{c}").alias(n) for n, c in about.items()], F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = raw.groupBy("path", "size", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    own = W.partitionBy("path")
    missing = F.when(F.col("path").rlike(_PACKED_NAME), 0).otherwise(F.col("size") - F.sum("bytes").over(own))
    before = F.coalesce(F.sum("n").over(own.orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("path", "start", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(own).alias("last"), (missing >= 2).alias("marked"), missing.isin(0, 3).alias("ended"))
    lines = raw.join(F.broadcast(offsets), ["path", "start"]).withColumn("line_no", F.col("at") + F.col("shift"))
    lines = lines.withColumn("line", F.when(F.col("marked") & (F.col("line_no") == 1), F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")))
    if not returns:
        lines = lines.withColumn("line", F.when(F.col("ended") | (F.col("line_no") < F.col("last")), F.regexp_replace("line", r"\r\z", "")).otherwise(F.col("line")))
    return lines.select("file", F.regexp_extract("file", name, 1).try_cast("int").alias("page"), "line_no", "line")


def attach_companion_text(items: DataFrame, texts: DataFrame, stem: str) -> DataFrame:
    """Items in order of name with their text by stem, "" where missing, and its characters."""
    from eventpulse.operators.numbering import numbered  # which writes through this module

    named = items.join(texts.select(stem, "companion"), stem, "left").withColumn("companion", F.coalesce("companion", F.lit("")))
    named = numbered(named, ["collection"], [stem], "order_no")
    return named.withColumns({"companion_chars": F.length("companion").cast("long"), "companion_missing": F.col("companion") == ""})


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    df.write.mode("overwrite").options(**(CSV if fmt == "csv" else {})).format(fmt).save(path)


def to_geojson_features(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One Feature text per row with coordinates; all other columns are properties, nulls written out."""
    others = [c for c in df.columns if c not in (lat, lon)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties"))
    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*others[:1], F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def feature_collection(features: DataFrame, by: str) -> DataFrame:
    """(by, collection): a FeatureCollection text of each layer's features, in order of their text. A layer is one text by
    nature; layers too large for that are written as features (write_features)."""
    layers = features.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("all"))
    return layers.select(by, F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("collection"))


def write_features(features: DataFrame, by: str, path: str) -> None:
    """Layers of any size as folders of text files, a feature a line, which readers of line-delimited GeoJSON take."""
    features.select(by, F.col("feature").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def save_tables(spark: SparkSession, folder: str, required: list[str], optional: list[str], database: str) -> list[str]:
    """Tables of the session's catalog from Parquet, which outlive the session; else as register_tables."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    done = []
    for name in [*required, *optional]:
        try:
            spark.read.parquet(f"{folder}/{name}.parquet").write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
            done.append(name)
        except AnalysisException as e:
            if name in required or "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
    return done


def register_tables(spark: SparkSession, folder: str, required: list[str], optional: list[str]) -> list[str]:
    """Temporary views from Parquet; a missing required table is an error, a missing optional one is skipped."""
    done = []
    for name in [*required, *optional]:
        try:
            spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
            done.append(name)
        except AnalysisException as e:
            if name in required or "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
    return done


def table_row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.table(n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names])


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one split of a file, as they come, as one row a batch."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _PIECE[:-2]), strict=True))
        at, lines = batch.column("at").to_pylist(), batch.column("piece").to_pylist()
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        rows = [(*keys[i], at[i], b"\n".join(lines[i:end])) for i, end in zip(starts, [*starts[1:], len(keys)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), batch.schema.types, strict=True)], schema=batch.schema) if rows else batch


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, bytes, sha256) of files whose lines come in order. The reader drops a byte order mark at the beginning and a line
    feed at the end; the file's size tells which of them it has."""
    last, name, size, seen, with_mark, without = None, "", 0, 0, hashlib.sha256(), hashlib.sha256()

    def digest() -> pa.RecordBatch:
        missing = size - seen
        if missing not in (0, 1, len(_MARK), len(_MARK) + 1):
            raise ValueError(f"{last}: {seen} of {size} bytes were read")
        found = with_mark if missing >= len(_MARK) else without
        found.update(b"\n" * (missing % len(_MARK)))
        return pa.RecordBatch.from_pydict({"name": [name], "bytes": pa.array([size], pa.int64()), "sha256": [found.hexdigest()]})

    for batch in batches:
        for row in batch.to_pylist():
            begins = row["path"] != last
            if begins:
                if last is not None:
                    yield digest()
                last, name, size, seen, with_mark, without = row["path"], row["name"], row["size"], 0, hashlib.sha256(_MARK), hashlib.sha256()
            for piece in (row["piece"],) if begins else (b"\n", row["piece"]):
                seen += len(piece)
                with_mark.update(piece)
                without.update(piece)
    if last is not None:
        yield digest()


_PIECE, _MARK = ["path", "name", "size", "start", "at", "piece"], b"\xef\xbb\xbf"


def file_manifest(spark: SparkSession, folder: str, whole: int = 64_000_000) -> DataFrame:
    """(name, bytes, sha256) of each file. A file of up to `whole` bytes is one value. A larger one is read in splits, as lines
    of bytes, which are put in order and go through the digest one after another; no value holds more than a batch of lines.
    Packed files are one value at any size, as the line reader would unpack them; Spark's readers skip empty files."""
    whole = min(whole, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    read = {"format": "binaryFile", "recursiveFileLookup": "true"}
    packed = spark.read.load(folder, **read, pathGlobFilter=f"*.{{{','.join(_PACKED)}}}").filter(F.col("length") > whole)
    files = spark.read.load(folder, **read).filter(F.col("length") <= whole).unionByName(packed)
    small = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.options(lineSep="\n", recursiveFileLookup="true").text(folder).filter((F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_name").rlike(_PACKED_NAME))
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    about = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_size", "size"), ("file_block_start", "start"))]
    pieces = lines.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), *about, F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece"))
    pieces = pieces.mapInArrow(_joined_lines, pieces.schema).repartition("path").sortWithinPartitions("path", "start", "at")
    return small.unionByName(pieces.mapInArrow(_line_digests, small.schema))
