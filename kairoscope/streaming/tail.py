"""Session logs that only grow: lines of JSON, one file a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of a line. Fixed format of the logs.
LINE = "struct<type string, timestamp string, payload struct<id string, type string, role string, content array<struct<type string, text string>>>>"
TEXT_PARTS, ROLES = ("input_text", "output_text"), ("user", "assistant")


def parse(line: Column) -> Column:
    """role, text and timestamp of a message line; null for other lines, other roles and broken JSON."""
    row = F.from_json(line, LINE)
    parts = F.filter(row["payload"]["content"], lambda p: p["type"].isin(*TEXT_PARTS))
    text = F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"))
    message = (row["type"] == "response_item") & (row["payload"]["type"] == "message") & row["payload"]["role"].isin(*ROLES) & (text != "")
    return F.when(message, F.struct(row["payload"]["role"].alias("role"), text.alias("text"), row["timestamp"].alias("timestamp")))


def session_ids(lines: DataFrame) -> DataFrame:
    """file, session_id from each file's line of metadata; without one the file's name stands in."""
    row = F.from_json("line", LINE)
    found = lines.groupBy("file").agg(F.min(F.when(row["type"] == "session_meta", row["payload"]["id"])).alias("id"))
    return found.select("file", F.coalesce("id", F.regexp_extract("file", "([^/]+?)(\\.[^./]*)?$", 1)).alias("session_id"))


def messages(lines: DataFrame) -> DataFrame:
    """session_id, turn_index, role, text, timestamp of all messages of (file, number, line)."""
    from pyspark.sql import Window

    said = lines.withColumn("m", parse(F.col("line"))).where("m IS NOT NULL").join(session_ids(lines), "file")
    index = F.row_number().over(Window.partitionBy("session_id").orderBy("file", "number")) - 1
    return said.select("session_id", index.alias("turn_index"), "m.role", "m.text", "m.timestamp")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number, line of the whole logs below a path. A last line without its end is left for later."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.split("value", "\n")
    complete = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))  # what follows the last line end is not complete
    return whole.select("file", F.posexplode(complete).alias("number", "line")).where("line <> ''")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (file, line) of new files; the checkpoint keeps what was read."""
    return spark.readStream.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
