"""Table bindings: the driver's parquet tables seen as sensor data.

The packet tables are projections of ``events`` (one packet per event), so
every query reads the whole table and its cost grows with it.  All
arithmetic is written in the same operation order as the matching SQL in
``tremorlake.plans.sql`` so both engines produce the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SOIL_TYPES = ["Clay", "Gravel", "Rock", "Sand"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is stored: filters and columns reach the scan.  The operators take NaN for missing."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _props_number(props: Column) -> Column:
    return F.regexp_extract(props, r"([0-9]+)", 1).cast("double")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-9 packets: node, timestamp and the nine hardware channels."""
    e = table(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("value")
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("NODE_"), F.col("user_id").cast("string")).alias("node_id"),
        "event_type",
        (v / F.lit(25.0)).alias("ppv_mms"),
        (F.lit(20.0) + _props_number(F.col("props")) * F.lit(0.2)).alias("temperature_c"),
        (F.lit(0.02) + (eid % 7) * F.lit(0.013)).alias("acc_x_ms2"),
        (F.lit(0.02) + (eid % 11) * F.lit(0.009)).alias("acc_y_ms2"),
        (F.lit(0.03) + (eid % 13) * F.lit(0.006)).alias("acc_z_ms2"),
        (F.lit(15.0) + (eid % 50) * F.lit(0.7)).alias("frequency_hz"),
        (v / F.lit(250.0)).alias("psd_value"),
        (v / F.lit(25.0) * F.lit(0.6)).alias("geophone_mms"),
        (v / F.lit(50.0)).alias("seismometer_ms2"),
    )


def compact_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact-5 packets: vibration, tilt, temperature, moisture, displacement + node/time.

    Dirt: node_id NULL every 59th id and the text 'None' every 31st; timestamp NULL every
    67th and 'None' every 73rd; tilt NULL every 47th; moisture NULL every 43rd.
    """
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    node = (F.when(eid % 59 == 0, F.lit(None).cast("string"))
            .when(eid % 31 == 0, F.lit("None"))
            .otherwise(F.concat(F.lit("NODE_"), F.col("user_id").cast("string"))))
    return e.select(
        "event_id",
        node.alias("node_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(eid % 67 == 0, F.lit(None).cast("string")).when(eid % 73 == 0, F.lit("None"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        (F.col("value") / F.lit(100.0)).alias("vibration"),
        F.when(eid % 47 == 0, F.lit(None).cast("double")).otherwise(_props_number(F.col("props"))).alias("tilt"),
        (F.lit(20.0) + (eid % 30) * F.lit(0.5)).alias("temperature"),
        F.when(eid % 43 == 0, F.lit(None).cast("double")).otherwise((eid % 100).cast("double")).alias("moisture"),
        (F.col("value") / F.lit(50.0)).alias("displacement"),
    )


def raw_blast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18-column raw table with its original header spellings, plus dirt.

    Dirt (all derived from ``event_id``): a NULL ``Acc_X`` every 97th id, an
    unmapped level every 89th, a NULL level every 71st, a NULL soil type every
    61st, an out-of-range temperature every 83rd, an unparsable timestamp every
    53rd, and one exact extra copy of every 101st row.
    """
    e = table(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("value")
    soil = F.when(eid % 61 == 0, F.lit(None).cast("string"))
    for i, s in enumerate(SOIL_TYPES):
        soil = soil.when(F.col("user_id") % 4 == i, F.lit(s))
    level = (F.when(eid % 89 == 0, F.lit("Unknown"))
             .when(eid % 71 == 0, F.lit(None).cast("string"))
             .when(v < 50.0, F.lit("Low"))
             .when(v < 100.0, F.lit("Medium"))
             .otherwise(F.lit("High")))
    # every 101st packet arrives twice: one scan, copies made by a narrow explode
    copies = F.explode(F.sequence(F.lit(1), F.when(eid % 101 == 0, F.lit(2)).otherwise(F.lit(1))))
    base = e.select(copies.alias("_copy"), "*").select(
        "event_id",
        F.when(eid % 53 == 0, F.lit("not-a-time"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("Timestamp"),
        F.concat(F.lit("BLAST_"), (eid % 37).cast("string")).alias("Blast_ID"),
        (F.lit(50.0) + (eid % 17) * F.lit(5.0)).alias("Charge_Weight(kg)"),
        (F.lit(2.0) + (eid % 5) * F.lit(0.5)).alias("Burden(m)"),
        (F.lit(3.0) + (eid % 4) * F.lit(0.5)).alias("Spacing(m)"),
        ((eid % 6) * F.lit(17.0)).alias("Delay(ms)"),
        soil.alias("Soil_Type"),
        F.when(eid % 83 == 0, F.lit(200.0))
         .otherwise(F.lit(20.0) + _props_number(F.col("props")) * F.lit(0.2)).alias("Temperature(°C)"),
        ((eid % 9) * F.lit(0.7)).alias("Wind_Speed(m/s)"),
        (v / F.lit(50.0)).alias("Seismometer(m/s²)"),
        (v / F.lit(25.0) * F.lit(0.6)).alias("Geophone(mm/s)"),
        F.when(eid % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(0.02) + (eid % 7) * F.lit(0.013)).alias("Acc_X(m/s²)"),
        (F.lit(0.02) + (eid % 11) * F.lit(0.009)).alias("Acc_Y(m/s²)"),
        (F.lit(0.03) + (eid % 13) * F.lit(0.006)).alias("Acc_Z(m/s²)"),
        (v / F.lit(250.0)).alias("PSD_Value"),
        (v / F.lit(25.0)).alias("PPV(mm/s)"),
        (F.lit(15.0) + (eid % 50) * F.lit(0.7)).alias("Frequency(Hz)"),
        level.alias("Vibration_Level"),
    )
    return base


def waveform_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One waveform buffer per embedding row: samples in whole tenths (creates zeros, and sums are exact in any order)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id"),
        F.col("label"),
        F.transform("embedding", lambda x: F.round(x.cast("double") * 10, 0)).alias("samples"),
    )


def waveform_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of ``waveform_buffers``: (vec_id, label, i, x) with i the 1-based position."""
    return waveform_buffers(spark, sf_dir).select(
        "vec_id", "label", F.posexplode("samples").alias("pos", "x")
    ).select("vec_id", "label", (F.col("pos") + 1).alias("i"), "x")


def dirty_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-9 telemetry with what real sensor files hold: NaN, both infinities, NULL keys and labels, a constant column.

    Built after the scan's conversion, so the reports meet NaN itself: PPV is NaN every 29th id,
    the seismometer +Infinity every 211th and -Infinity every 223rd, the packet key NULL every
    37th, the label NULL every 19th; ``gain`` is always 1.
    """
    t = telemetry(spark, sf_dir)
    eid = F.col("event_id")
    label = (F.when(eid % 19 == 0, F.lit(None).cast("string")).when(F.col("ppv_mms") < 2.0, F.lit("NORMAL"))
             .when(F.col("ppv_mms") < 4.0, F.lit("WARNING")).otherwise(F.lit("CRITICAL")))
    return t.select(
        "event_id", F.when(eid % 37 != 0, eid).alias("packet"), label.alias("risk_label"),
        F.when(eid % 29 == 0, F.lit(float("nan"))).otherwise(F.col("ppv_mms")).alias("ppv_mms"),
        F.when(eid % 211 == 0, F.lit(float("inf"))).when(eid % 223 == 0, F.lit(float("-inf")))
         .otherwise(F.col("seismometer_ms2")).alias("seismometer_ms2"),
        "geophone_mms", "temperature_c", F.lit(1.0).alias("gain"))
