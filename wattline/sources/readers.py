"""Stream and batch readers for power records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.quality import CORRUPT

# What readers add to say in which order records were written.
ARRIVAL = "arrival"


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    file_format: str = "parquet",
    glob: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Records arriving as files in a folder.

    A schema without ``arrival`` gets one: time and path of the file, and the place in it. JSON and CSV
    lines that cannot be decoded are kept in ``_corrupt_record`` for the quarantine.
    """
    text = file_format in ("json", "csv")
    if text:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.format(file_format).schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if text:
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    rows = reader.load(folder)
    return rows if ARRIVAL in schema.names else rows.select("*", _file_arrival(file_format).alias(ARRIVAL))


def _file_arrival(file_format: str) -> Column:
    # Parquet numbers its rows; elsewhere the block is known, and order inside it is that of reading.
    place = "row_index" if file_format == "parquet" else "file_block_start"
    return F.struct("_metadata.file_modification_time", "_metadata.file_path", f"_metadata.{place}")


def text_records(spark: SparkSession, folder: str, schema: T.StructType, file_format: str = "json") -> DataFrame:
    """JSON or CSV records; undecodable lines are kept in ``_corrupt_record`` instead of failing."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.format(file_format)
        .schema(with_corrupt)
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .load(folder)
    )


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    avro_schema: str,
    *,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
    header_bytes: int = 5,
) -> DataFrame:
    """Records of a topic with String keys and Avro values.

    Adds ``messageKey``, ``messageTimestamp`` (epoch ms) and ``arrival`` (time, partition and
    offset, because a payload's identifier may come from several partitions). ``header_bytes`` is
    what precedes the Avro body: 5 with a schema registry, 0 without, as ``kafka_feed`` writes. A
    value that cannot be decoded is kept, in base 64, in ``_corrupt_record``. Needs the Kafka and
    Avro packages.
    """
    from pyspark.sql.avro.functions import from_avro

    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    body = F.expr(f"substring(value, {header_bytes + 1})")
    return decoded(
        reader.load().select(
            from_avro(body, avro_schema, {"mode": "PERMISSIVE"}).alias("record"),
            F.col("key").cast("string").alias("messageKey"),
            F.unix_millis("timestamp").alias("messageTimestamp"),
            F.struct("timestamp", "partition", "offset").alias(ARRIVAL),
            F.col("value"),
        )
    )


def decoded(messages: DataFrame) -> DataFrame:
    """The fields of ``record`` beside the other columns; what could not be decoded is kept in ``_corrupt_record``.

    A permissive decoder gives a null, or a record of nulls only, for what it cannot read. A record with some
    fields missing has been read: its identifier may be null, and windows that follow the message key still count it. A message
    without value is no record and nothing to keep.
    """
    fields = [f"record.{name}" for name in messages.schema["record"].dataType.names]
    nothing = F.coalesce(*(F.when(F.col(field).isNotNull(), F.lit(1)) for field in fields)).isNull()
    others = [c for c in messages.columns if c not in ("record", "value")]
    return messages.select("record.*", *others, F.when(nothing, F.base64("value")).alias(CORRUPT))
