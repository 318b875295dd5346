"""Signals derived from the driver's tables: what the operators are applied to when no recordings are at hand.

Each function returns a DataFrame; ``SQL`` holds the same definition for the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, frame, left, right: one frame per event of a user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", r"(-?[0-9]+)", 1).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording"), (F.row_number().over(order) - 1).cast("long").alias("frame"), (F.col("value") / 100 - 0.5).alias("left"), (k / 100 - 0.5).alias("right"), "event_type", k.alias("k")
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``frames``, with digital silence, invalid samples and clipping."""
    f = frames(spark, sf_dir)
    clipped = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), "left"))
    left = F.when(F.col("event_type") == "error", 0.0).when((F.col("event_type") == "signup") & (F.col("k") < 10), float("nan")).otherwise(clipped)
    return f.select("recording", "frame", left.alias("left"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("right")).alias("right"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, step, energy (K-weighted), correlation: one 100 ms step per order line of a supplier."""
    lines = table(spark, sf_dir, "lineitem")
    plain = [F.col(c) + 0.0 if t == "double" else F.col(c) for c, t in lines.dtypes]
    order = Window.partitionBy("l_suppkey").orderBy(*plain)
    e = F.pow(F.col("l_extendedprice") / 1e5, F.lit(2.0)) * 0.01 * F.when(F.col("l_returnflag") == "R", 1e-8).otherwise(1.0)
    return lines.select(F.col("l_suppkey").alias("recording"), (F.row_number().over(order) - 1).cast("long").alias("step"), e.alias("energy"), (2 * F.col("l_discount") / 0.1 - 1).alias("correlation"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, block_no, start_frame, samples: one block of 64 samples per vector of a label."""
    order = Window.partitionBy("label").orderBy("vec_id")
    number = (F.row_number().over(order) - 1).cast("long")
    samples = F.col("embedding").cast("array<double>")
    out = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording"), F.lit(0).alias("channel"), number.alias("block_no"), samples.alias("samples"))
    return out.withColumn("start_frame", F.col("block_no") * 64)


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, block_no, start_frame, samples: paired blocks, the right channel from the left one; some samples are invalid, some clipped."""
    b = blocks(spark, sf_dir)
    frame = lambda i: F.col("start_frame") + i
    left = F.transform("samples", lambda x, i: F.when(frame(i) % 41 == 7, float("nan")).otherwise(F.greatest(F.lit(-0.1), F.least(F.lit(0.1), x))))
    right = F.transform(F.reverse("samples"), lambda x, i: F.when(frame(i) % 97 == 5, float("inf")).otherwise(x / 2))
    return b.select("recording", "block_no", "start_frame", F.array(left, right).alias("samples"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, series, loudness, peak, duration, gain, priority: one measured recording per order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("recording"), F.col("c_mktsegment").alias("series"), (F.floor((F.col("o_totalprice") / 4e4 - 30) * 1e4 + 0.5) / 1e4).alias("loudness"), (F.col("o_totalprice") % 700 / 100 - 6).alias("peak"),
        (F.col("o_orderkey") % 1500 + 30).cast("double").alias("duration"), (F.col("o_custkey") % 25 - 12).cast("double").alias("gain"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("stage"),
        F.col("o_orderdate").alias("measured"), F.col("c_nationkey").cast("long").alias("place"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, size, recording: one file per document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("recording"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    ).withColumn("size", F.octet_length("content").cast("long"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, id, type, severity, seconds, end_seconds, text, review: one marker per event."""
    f = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", r"(-?[0-9]+)", 1).cast("double")
    severity = F.when(k < 10, "critical").when(k < 40, "review").otherwise("info")
    seconds = ((F.row_number().over(order) - 1) * 2).cast("double")
    text = F.when(F.col("event_type") == "click", "Possible flat-top run").when(F.col("event_type") == "error", "Digital zero").when(F.col("event_type") == "view", "Sample over full scale").otherwise(F.concat(F.lit("Note "), "event_type"))
    return f.select(
        F.col("user_id").alias("recording"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("type"), severity.alias("severity"), seconds.alias("seconds"),
        (seconds + k / 20).alias("end_seconds"), text.alias("text"), F.when(F.col("event_id") % 3 == 0, "reviewed").otherwise("open").alias("review"),
    )


_FRAMES = """frames as (select user_id as recording, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value / 100 - 0.5 as "left",
 cast(regexp_extract(props, '(-?[0-9]+)', 1) as double) / 100 - 0.5 as "right", event_type, cast(regexp_extract(props, '(-?[0-9]+)', 1) as double) as k from events)"""

SQL = {
    "frames": _FRAMES,
    "dirty": _FRAMES + """, dirty as (select recording, frame, case when event_type = 'error' then 0.0 when event_type = 'signup' and k < 10 then 'nan'::double else greatest(-0.2, least(0.2, "left")) end as "left",
 case when event_type = 'error' then 0.0 else "right" end as "right" from frames)""",
    "steps": """steps as (select l_suppkey as recording, row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 0.0, l_extendedprice + 0.0, l_discount + 0.0, l_tax + 0.0, l_returnflag, l_linestatus, l_shipdate) - 1 as step,
 pow(l_extendedprice / 1e5, 2.0) * 0.01 * case when l_returnflag = 'R' then 1e-8 else 1.0 end as energy, 2 * l_discount / 0.1 - 1 as correlation from lineitem)""",
    "blocks": """blocks as (select cast(label as bigint) as recording, row_number() over (partition by label order by vec_id) - 1 as block_no, embedding::double[] as samples from embeddings),
 samples as (select recording, block_no * 64 + i - 1 as frame, samples[i] as value from (select *, unnest(range(1, 65)) as i from blocks))""",
    "stereo": """blocks as (select cast(label as bigint) as recording, row_number() over (partition by label order by vec_id) - 1 as block_no, embedding::double[] as samples from embeddings),
 stereo as (select recording, block_no * 64 + i - 1 as frame, case when (block_no * 64 + i - 1) % 41 = 7 then 'nan'::double else greatest(-0.1, least(0.1, samples[i])) end as "left", case when (block_no * 64 + i - 1) % 97 = 5 then 'inf'::double else samples[65 - i] / 2 end as "right" from (select *, unnest(range(1, 65)) as i from blocks)),
 channels as (select recording, frame, 0 as channel, "left" as value from stereo union all select recording, frame, 1, "right" from stereo)""",
    "reports": """reports as (select o_orderkey as recording, c_mktsegment as series, floor((o_totalprice / 4e4 - 30) * 1e4 + 0.5) / 1e4 as loudness, o_totalprice % 700 / 100 - 6 as peak, cast(o_orderkey % 1500 + 30 as double) as duration,
 cast(o_custkey % 25 - 12 as double) as gain, o_orderpriority as priority, o_orderstatus as stage, o_orderdate as measured, c_nationkey as place from orders join customer on o_custkey = c_custkey)""",
    "files": """files as (select doc_id as recording, source || '/' || doc_id as path, coalesce(text, '') as content, strlen(coalesce(text, '')) as size from documents)""",
    "markers": """markers as (select user_id as recording, 'm' || event_id as id, event_type as type, case when k < 10 then 'critical' when k < 40 then 'review' else 'info' end as severity, cast(n * 2 as double) as seconds, n * 2 + k / 20 as end_seconds,
 case event_type when 'click' then 'Possible flat-top run' when 'error' then 'Digital zero' when 'view' then 'Sample over full scale' else 'Note ' || event_type end as text, case when event_id % 3 = 0 then 'reviewed' else 'open' end as review
 from (select *, cast(regexp_extract(props, '(-?[0-9]+)', 1) as double) as k, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events))""",
}
