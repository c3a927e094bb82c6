"""Chat logs and traces: JSON lines or arrays with defaults, and the claims that a trace holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoscope.functions.interval import micros_of_text

TURN = "role string, content string, project_id string, session_id string, turn_index int, source_agent string, timestamp string"
#: The row kinds of a trace share one schema; a row of one kind leaves the columns of the others null.
TRACE = (
    "type string, project_id string, session_id string, turn_index int, entity_name string, entity_type string, predicate string, content string, captured_at string, "
    "source_key string, content_hash string, subject string, subject_kind string, object string, object_kind string, source_kind string, "
    "query_id string, domain string, query string, as_of string, expected_entity string, seed_entities array<struct<name:string,kind:string>>, high_stakes boolean"
)


def chat_turns(spark: SparkSession, path: str, project_id: str = "cli", session_id: str | None = None, source_agent: str | None = None, array: bool = False) -> DataFrame:
    """Turns of JSON lines, or of files that hold one JSON array each (``array``), with defaults.

    ``session_id`` takes the place of every turn's own; without it a turn that names none is a session
    of its own. Turns are numbered by their place in their file unless they have an index. Lines that
    are no JSON have a null index and stand in ``_corrupt``.
    """
    read = spark.read.schema(TURN + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", str(array).lower())
    rows = read.json(path).withColumns({"__file": F.input_file_name(), "__at": F.monotonically_increasing_id(), "__ok": F.col("_corrupt").isNull()})
    place = F.row_number().over(Window.partitionBy("__file", "__ok").orderBy("__at")) - 1
    own = F.coalesce("session_id", F.concat(F.lit("chat-ingest-"), place.cast("string")))
    columns = {
        "turn_index": F.when(F.col("__ok"), F.coalesce("turn_index", place)),
        "session_id": F.when(F.col("__ok"), own if session_id is None else F.lit(session_id)),
        "project_id": F.coalesce("project_id", F.lit(project_id)),
        "source_agent": F.coalesce("source_agent", F.lit(source_agent).cast("string")),
    }
    return rows.withColumns(columns).drop("__file", "__at", "__ok")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a trace of JSON lines, of any kind."""
    return spark.read.schema(TRACE).json(path).where("type IS NOT NULL")


def trace_claims(trace: DataFrame) -> DataFrame:
    """project_id, subject_kind, subject, predicate, object_kind, object, valid_from, source_kind, source_id, excerpt: what a trace claims; its queries claim nothing."""
    kind, at = F.col("type"), micros_of_text(F.col("captured_at"))
    turn = F.concat_ws(":", "session_id", F.col("turn_index").cast("string"))
    finding = F.concat_ws(":", "source_key", "content_hash")
    of_turn, of_claim = kind == "conversation_relation", kind == "research_claim"
    rows = trace.where(kind.isin("conversation_relation", "research_claim", "research_relation"))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    source_kind = F.when(of_turn, "conversation_turn").when(of_claim, F.coalesce("source_kind", F.lit("research_finding"))).otherwise(F.col("source_kind"))
    source_id = F.when(of_turn, turn).otherwise(finding)
    return rows.select(
        "project_id",
        F.when(of_claim, unknown("subject_kind")).otherwise(source_kind).alias("subject_kind"),
        F.when(of_claim, F.col("subject")).otherwise(source_id).alias("subject"),
        F.when(of_claim, F.col("predicate")).otherwise(F.coalesce("predicate", F.lit("MENTIONS"))).alias("predicate"),
        F.when(of_claim, unknown("object_kind")).otherwise(F.col("entity_type")).alias("object_kind"),
        F.when(of_claim, F.col("object")).otherwise(F.col("entity_name")).alias("object"),
        at.alias("valid_from"),
        source_kind.alias("source_kind"),
        source_id.alias("source_id"),
        F.col("content").alias("excerpt"),
    )
