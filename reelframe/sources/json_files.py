"""JSON documents: parsed scripts, rules, sessions, projects. Bad files are left out or fail, as stated for each."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCRIPT = (
    "title string, author string, source_format string, source_filename string, parse_confidence string, "
    "scenes array<struct<scene_number:int,heading_raw:string,int_ext:string,location:string,time_of_day:string,page_start:double,page_end:double,"
    "elements:array<struct<type:string,text:string,character:string,line_start:int>>,characters_present:array<string>>>, "
    "front_matter array<struct<type:string,text:string,character:string,line_start:int>>, "
    "warnings array<struct<message:string,scene_number:int,severity:string>>"
)
RULE = (
    "id string, name string, taxonomy_level string, category string, source struct<type:string,originator:string,work:string,note:string>, definition string, "
    "detection_signal string, counter_considerations string, severity_default string, confidence_tier string, requires array<string>, related_rules array<string>"
)
SESSION = "session_id string, title string, updated_at double, active_branch string, branches map<string,struct<name:string,messages:array<struct<role:string,content:string,ts:double,mode:string,scene_refs:array<int>>>>>"
PROJECT = "project_name string, title string, report_language string, drafts array<struct<name:string,created_at:double>>, stages map<string,struct<status:string,detail:string,updated_at:double>>"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file that holds a JSON object, missing keys null; corrupt files are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("d"))
    return rows.where("d is not null and d._bad is null").select("path", "d.*").drop("_bad")


def read_scripts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    docs = read_documents(spark, path, SCRIPT).withColumnRenamed("path", "script_id")
    scenes = docs.select("script_id", F.explode("scenes").alias("s"))
    front = docs.select("script_id", F.lit(0).alias("scene_number"), F.posexplode("front_matter").alias("element_index", "e"))
    inner = scenes.select("script_id", F.col("s.scene_number").alias("scene_number"), F.posexplode("s.elements").alias("element_index", "e"))
    elements = inner.unionByName(front).select("script_id", "scene_number", "element_index", "e.*")
    return {
        "scripts": docs.select("script_id", "title", "author", "source_format", "source_filename", F.coalesce("parse_confidence", F.lit("medium")).alias("parse_confidence")),
        "scenes": scenes.select("script_id", "s.scene_number", "s.heading_raw", "s.int_ext", "s.location", "s.time_of_day", "s.page_start", "s.page_end"),
        "elements": elements,
        "presence": scenes.select("script_id", F.col("s.scene_number").alias("scene_number"), F.explode("s.characters_present").alias("character")),
    }


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all files; an id that occurs twice fails the query."""
    rows = spark.read.schema(RULE).option("multiLine", True).json(path)
    n = F.count("*").over(Window.partitionBy("id"))
    return rows.withColumn("id", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate rule id: "), F.col("id")))).otherwise(F.col("id")))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Chat sessions, newest first."""
    return read_documents(spark, path, SESSION).orderBy(F.desc("updated_at"), "session_id")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project manifests by title."""
    return read_documents(spark, path, PROJECT).orderBy("title", "path")
