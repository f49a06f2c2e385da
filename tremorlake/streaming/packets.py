"""Structured Streaming: packet ingest, validation, features, scoring, alerts, windows, dedup.

The same Column functions as the batch path run on the stream.  Sinks are
idempotent: ``foreachBatch`` overwrites one folder per batch id, so a batch
replayed after a failure rewrites the same files instead of appending twice.
Event time must be TIMESTAMP (not TIMESTAMP_NTZ) for a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake import constants as K
from tremorlake.functions.waveform import FEATURE_NAMES
from tremorlake.operators import clean, features, model
from tremorlake.operators.waveform import sign_change, zero_change

COMPACT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("vibration", T.DoubleType()),
    T.StructField("tilt", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("moisture", T.DoubleType()),
    T.StructField("displacement", T.DoubleType()),
])

RAW9_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
] + [T.StructField(c, T.DoubleType()) for c in K.RAW_CHANNELS])


def write_packet_files(df: DataFrame, path: str) -> str:
    """Land packets as parquet files, as many as the frame has partitions (a stand-in for an arriving packet folder)."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_packets(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Streaming file source with a fixed schema (no inference on a stream)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


#: What a JSON reading may look like; hex, type suffixes, NaN and infinities are no readings.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_json(lines: DataFrame, schema: T.StructType = COMPACT_SCHEMA,
               required: list[str] = clean.COMPACT_REQUIRED) -> DataFrame:
    """JSON packets of ``lines(value)``: the columns of ``schema``, ``line`` and ``reason`` (NULL: valid).

    A line that is no JSON object (broken, cut, blank, an array) is
    ``malformed`` and has no fields.  Otherwise the reason names the fields whose
    value is not of their type (``mistyped: a,b``; a number in quotes is a
    number) and the required ones without a value (``missing: c``), joined by
    ``; ``; such fields are NULL.  Unknown fields are ignored; of a repeated field the first counts.
    """
    raw = F.col("m")
    typed, wrong, absent = [], [], []
    for f in schema.fields:
        text = F.try_element_at(raw, F.lit(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(text.rlike(NUMBER), text.try_cast(f.dataType))
            value = F.when(F.abs(value) < F.lit(float("inf")), value)
        else:
            value = text.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        wrong.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
        if f.name in required:
            absent.append(F.when(text.isNull(), F.lit(f.name)))
    listed = lambda word, names: F.when(F.concat_ws(",", *names) != "",
                                        F.concat(F.lit(f"{word}: "), F.concat_ws(",", *names)))
    faults = F.concat_ws("; ", listed("mistyped", wrong), listed("missing", absent))
    reason = F.when(raw.isNull(), F.lit("malformed")).when(faults != "", faults)
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(*typed, "line", reason.alias("reason"))


def read_json_lines(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming source of text files with one JSON packet a line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def ingest_json(lines: DataFrame, out_dir: str, checkpoint: str):
    """ST1 on JSON: every line is parsed once and lands in ``packets`` or, with its reason, in ``quarantine``.

    A batch is one folder below ``out_dir``, partitioned by ``sink``; ``ingested`` reads them.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        to = F.when(F.col("reason").isNull(), F.lit("packets")).otherwise(F.lit("quarantine"))
        parse_json(batch).withColumn("sink", to).write.mode("overwrite").partitionBy("sink") \
            .parquet(f"{out_dir}/batch={batch_id}")

    return (lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingested(spark: SparkSession, out_dir: str, sink: str) -> DataFrame:
    """Rows of one sink of ``ingest_json``: packets have the packet columns, quarantine also line and reason."""
    schema = T.StructType([*COMPACT_SCHEMA.fields, T.StructField("line", T.StringType()),
                           T.StructField("reason", T.StringType()), T.StructField("batch", T.LongType()),
                           T.StructField("sink", T.StringType())])
    rows = spark.read.schema(schema).parquet(out_dir).filter(F.col("sink") == sink).drop("batch", "sink")
    return rows.drop("line", "reason") if sink == "packets" else rows


def score_stream(stream: DataFrame, fitted, model_name: str, out_dir: str, checkpoint: str):
    """ST1-ST4: validate -> quarantine | derive + score -> scores; CRITICAL rows -> alerts.

    Returns the started query (``trigger(availableNow=True)``: drains the folder, then stops).
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        checked = clean.validate_compact(batch)
        checked.where(~F.col("is_valid")).write.mode("overwrite").parquet(f"{out_dir}/quarantine/batch={batch_id}")
        scores = f"{out_dir}/scores/batch={batch_id}"
        model.score(fitted, checked.where("is_valid"), model_name, keep=["event_id", "ts"]) \
            .drop("probabilities").write.mode("overwrite").parquet(scores)
        # alerts are taken from the written scores: a packet is scored once
        batch.sparkSession.read.parquet(scores).where(F.col("risk_level") == K.CRITICAL) \
            .write.mode("overwrite").parquet(f"{out_dir}/alerts/batch={batch_id}")

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def rule_alert_stream(stream: DataFrame, out_dir: str, checkpoint: str,
                      threshold: float = K.RULE_ALERT_MAGNITUDE):
    """ST5: model-free alert on the resultant acceleration, appended to parquet."""
    alerts = clean.rule_alerts(features.derive(stream), threshold)
    return (alerts.select("event_id", "node_id", "ts", "vibration_magnitude_ms2").writeStream
            .format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def window_stream(stream: DataFrame, value: str, out_dir: str, checkpoint: str, window: str = "1 hour",
                  delay: str = "10 minutes", chunk: str = "10 seconds"):
    """ST6: tumbling-window waveform features per node, finalised windows appended.

    Two aggregations: samples are summed up per short ``chunk`` (counts, sums,
    extremes, crossings inside it, its first and last sample), and the chunks
    per window; a window's state is one summary per chunk however many samples
    a node sends.  Samples are ordered by (ts, event_id).
    """
    x, at = F.col(value), F.struct("ts", "event_id")
    chunks = (stream.withWatermark("ts", delay).groupBy(F.window("ts", chunk).alias("c"), "node_id").agg(
        F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("ts", "event_id", x.alias("x"))))).alias("v")))
    # inside the bounded chunk: neighbours of its samples; only the summary goes on
    prior, later = F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1)
    crossings = lambda differ: F.when(F.size("v") > 1, F.aggregate(
        F.zip_with(prior, later, lambda a, b: differ(a["x"], b["x"])), F.lit(0), lambda acc, d: acc + d)).otherwise(0)
    # squares about the chunk's own mean, moved to the window's mean below: no difference of large sums
    apart = F.aggregate("v", F.lit(0.0), lambda acc, a: acc + (a["x"] - F.col("s") / F.col("n"))
                        * (a["x"] - F.col("s") / F.col("n")))
    summary = chunks.filter(F.col("n") > 0).select(
        "c", "node_id", F.struct(
            F.col("c.start").alias("at"), "n", "s", "q", "lo", "hi", crossings(zero_change).alias("zc"),
            crossings(sign_change).alias("sc"), F.try_element_at("v", F.lit(1))["x"].alias("first"),
            F.try_element_at("v", F.lit(-1))["x"].alias("last"), apart.alias("m2")).alias("p"))
    windows = summary.groupBy(F.window(F.window_time("c"), window).alias("w"), "node_id").agg(
        F.sort_array(F.collect_list("p")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p[f])
    n = F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    before, after = F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1)
    border = lambda differ: F.when(F.size("p") > 1, F.aggregate(
        F.zip_with(before, after, lambda a, b: differ(a["last"], b["first"])), F.lit(0),
        lambda acc, d: acc + d)).otherwise(0)
    middle = total("s") / n
    spread = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["m2"] + p["n"] * (p["s"] / p["n"] - middle)
                         * (p["s"] / p["n"] - middle))
    base = windows.filter(F.size("p") > 0).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "node_id", n.alias("n"),
        spread.alias("m2"), total("s").alias("s"), total("q").alias("q"), F.array_min("p.lo").alias("min"), F.array_max("p.hi").alias("max"),
        (total("zc") + border(zero_change)).alias("zc"), (total("sc") + border(sign_change)).alias("sc"))
    mean, rms = F.col("s") / F.col("n"), F.sqrt(F.col("q") / F.col("n"))
    peak, steps = F.greatest(F.abs("min"), F.abs("max")), F.greatest(F.col("n") - 1, F.lit(1))
    features_of = {
        "mean": mean, "std": F.sqrt(F.col("m2") / F.col("n")), "min": F.col("min"),
        "max": F.col("max"), "peak_amplitude": peak, "peak_to_peak": F.col("max") - F.col("min"), "rms": rms,
        "signal_energy": F.col("q"), "crest_factor": peak / (rms + F.lit(K.CREST_EPS)),
        "zero_crossing_rate": F.col("zc") / steps, "sign_change_rate": F.col("sc") / steps}
    out = base.select("window_start", "window_end", "node_id", "n", *[features_of[f].alias(f) for f in FEATURE_NAMES])
    return (out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def dedup_stream(stream: DataFrame, out_dir: str, checkpoint: str, key: str = "event_id",
                 delay: str = "10 minutes"):
    """ST7: drop repeated packets (same id) that arrive within the watermark delay."""
    d = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    return (d.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def run(query) -> None:
    """Wait for an availableNow query to drain its source; re-raise its failure."""
    query.awaitTermination()
    exc = query.exception()
    if exc is not None:
        raise RuntimeError(str(exc))
