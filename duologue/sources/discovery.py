"""Sessions from a folder of recordings or from a manifest.

A folder's files are classified by a delimited view token in their names -- ``close_a``,
``close_b`` or ``wide`` -- and grouped by what is left of the name. Where no name holds a token,
the right-most field in which every value is shared by exactly two files pairs them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Recording suffixes and the tokens that name a view.
SUFFIXES = ("mp4", "mov", "mkv", "avi", "m4v", "webm", "mts")
EDGE, END = r"(?:^|[\s_.\-])", r"(?=$|[\s_.\-])"
VIEWS = {
    "wide": r"(?:wide|both|front|master|two[\s_\-]?shot|overview)",
    "close_a": r"(?:close[\s_\-]?a|cam[\s_\-]?a|person[\s_\-]?a|a)",
    "close_b": r"(?:close[\s_\-]?b|cam[\s_\-]?b|person[\s_\-]?b|b)",
}


class SessionError(ValueError):
    pass


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem) of every recording below a folder; the files' contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*SUFFIXES, *map(str.upper, SUFFIXES)]) + "}").load(root).select("path")
    return found.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def classify(files: DataFrame) -> DataFrame:
    """Adds ``role`` (wide wins, else the one close view named, else null) and ``session_id``, the name without the token."""
    low = F.lower("stem")
    named = {v: low.rlike(EDGE + p + END) for v, p in VIEWS.items()}
    role = F.when(named["wide"], "wide").when(named["close_a"] & ~named["close_b"], "close_a").when(named["close_b"] & ~named["close_a"], "close_b")
    rows = files.withColumn("role", role)
    stripped = F.col("stem")
    for v, p in VIEWS.items():
        stripped = F.when(F.col("role") == v, F.regexp_replace("stem", "(?i)" + EDGE + p + END, "")).otherwise(stripped)
    return rows.withColumn("session_id", F.regexp_replace(stripped, r"^[\s_.\-]+|[\s_.\-]+$", ""))


def pair_by_shared_field(files: DataFrame) -> DataFrame:
    """(path, stem, session_id, role) of files without view tokens; the first by name is close_a."""
    fields = files.withColumn("fields", F.split("stem", r"[\s_.\-]+"))
    shape = fields.agg(F.count("*").alias("n"), F.count_distinct(F.size("fields")).alias("widths")).first()
    if shape["n"] % 2 or shape["widths"] > 1:
        raise SessionError("files without view tokens must be even in number and have the same number of fields")
    values = fields.select("path", F.posexplode("fields").alias("pos", "value"))
    counts = values.groupBy("pos", "value").count().groupBy("pos").agg(F.bool_and(F.col("count") == 2).alias("pairs"), F.count("*").alias("k")).filter("pairs")
    best = counts.agg(F.max("pos").alias("pos")).first()["pos"]
    if best is None:
        raise SessionError("no field of the file names is shared by exactly two files each")
    order = Window.partitionBy("session_id").orderBy("stem")
    named = fields.withColumn("session_id", F.element_at("fields", best + 1)).withColumn("role", F.when(F.row_number().over(order) == 1, "close_a").otherwise("close_b"))
    return named.select("path", "stem", "session_id", "role")


def discover_sessions(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """(session_id, views): a map from role to path for every session found."""
    files = recordings(spark, root)
    rows = classify(files)
    if not rows.filter("role IS NOT NULL").head(1):
        rows = pair_by_shared_field(files)
    rows = rows.filter("role IS NOT NULL")
    twice = rows.groupBy("session_id", "role").count().filter("count > 1").head(1)
    if twice:
        raise SessionError(f"session {twice[0]['session_id']} has several files for {twice[0]['role']}")
    views = rows.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "path")))).alias("views"))
    if strict:
        views = views.filter(F.map_contains_key("views", "close_a") & F.map_contains_key("views", "close_b"))
    return views


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, views, metadata) from a JSON list or single object; relative paths are taken from the manifest's folder."""
    folder = re.sub(r"[^/]*$", "", path)
    raw = spark.read.schema("session_id string, views map<string,string>, metadata map<string,string>").json(path, multiLine=True)
    number = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    absolute = F.transform_values("views", lambda k, v: F.when(v.rlike(r"^(/|[a-z0-9]+:/)"), v).otherwise(F.concat(F.lit(folder), v)))
    return raw.withColumn("__n", number).select(F.coalesce("session_id", F.format_string("session%03d", "__n")).alias("session_id"), absolute.alias("views"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def iter_sessions(spark: SparkSession, target: str, strict: bool = True) -> DataFrame:
    return load_manifest(spark, target) if target.lower().endswith(".json") else discover_sessions(spark, target, strict)
