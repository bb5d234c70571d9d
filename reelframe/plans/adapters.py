"""Star-schema, event and text tables seen as scripts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written under the shared folder and read from there: what several branches read is made once."""
    path = f"{shared_folder(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def elements(spark: SparkSession, sf_dir: str, text=None) -> DataFrame:
    """Conversations as elements: ten conversations a script, one a scene; system turns are action."""
    rows = table(spark, sf_dir, "conversations")
    action = F.col("role") == "system"
    return rows.select(
        F.floor(F.col("conv_id") / 10).cast("long").alias("script_id"), (F.col("conv_id") % 10 + 1).cast("int").alias("scene_number"),
        F.col("turn").cast("int").alias("element_index"), F.when(action, "action").otherwise("dialogue").alias("type"),
        (F.col("text") if text is None else text).alias("text"), F.when(~action, F.upper("role")).alias("character"),
    )


def lines_of_speech(spark: SparkSession, sf_dir: str, text=None) -> DataFrame:
    """(script_id, scene_number, element_index, speaker, text) of spoken turns."""
    return elements(spark, sf_dir, text).where("character is not null").withColumnRenamed("character", "speaker").drop("type")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where("character is not null").select("script_id", "scene_number", "character").distinct()


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("script_id", "scene_number").distinct()


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scenes of their nation, with a heading built from their columns."""
    side = F.when(F.col("c_custkey") % 2 == 0, "INT. ").otherwise("EXT. ")
    k = F.col("c_custkey") % 5
    time = F.when(k == 0, " - DAY").when(k == 1, " - NIGHT").when(k == 2, " - MORNING").when(k == 3, " - CONTINUOUS").otherwise("")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("script_id"), F.col("c_custkey").alias("scene_number"), F.concat(side, F.upper("c_mktsegment"), time).alias("heading_raw"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def orders_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes, their suppliers as characters, a row a line."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")


def generated_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text scripts written out from conversations: a heading a conversation, a cue and a line a turn."""
    rows = table(spark, sf_dir, "conversations").withColumn("script_id", F.floor(F.col("conv_id") / 10).cast("long"))
    turn = F.concat(F.upper("role"), F.lit("\nso "), F.regexp_replace("text", r"\s+", " "), F.lit("\n"))
    scene = rows.groupBy("script_id", "conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    scene = scene.withColumn("t", F.concat(F.lit("INT. ROOM "), F.col("conv_id").cast("string"), F.lit(" - DAY\n\n"), F.col("body")))
    text = scene.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return text.withColumn("source_format", F.lit("fountain")).withColumn("source_filename", F.concat(F.col("script_id").cast("string"), F.lit(".fountain")))
