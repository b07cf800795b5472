"""Append-only journals of heterogeneous JSON records, and the tables and manifests made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.sources.shared import cut

RECT = "struct<x:double,y:double,width:double,height:double>"
OBSERVATION = "struct<observationID:string,observedAt:string,value:string,placeholderValue:string,selectedRangeLocation:int,selectedRangeLength:int,valueWasTruncated:boolean>"
PROBE = "struct<errors:array<string>,left:struct<text:string,axError:string,rangeLength:int>,selected:struct<text:string,axError:string,rangeLength:int>,right:struct<text:string,axError:string,rangeLength:int>>"
BEFORE = f"{OBSERVATION[:-1]},valueRepresentedPlaceholder:boolean,axRangeCursorProbe:{PROBE}>"
SURFACE = f"struct<displayID:bigint,windowID:bigint,windowTitle:string,windowBounds:{RECT},appName:string,bundleIdentifier:string,processIdentifier:int>"
CHECKPOINT = f"struct<checkpointID:string,eventTimestampNanoseconds:bigint,axErrors:array<string>,inputObservedAt:string,observation:{OBSERVATION}>"
PASTE = f"struct<checkpointID:string,eventTimestampNanoseconds:bigint,axErrors:array<string>,prePasteAXErrors:array<string>,clipboardSnapshotID:string,clipboardChangeCount:bigint,clipboardTextWasTruncated:boolean,inputObservedAt:string,clipboardText:string,prePasteObservation:{OBSERVATION},observation:{OBSERVATION}>"
TARGET = "struct<elementHash:bigint,processIdentifier:int,bundleIdentifier:string,windowTitle:string,role:string,subrole:string,accessibilityIdentifier:string,fieldLabel:string,fieldDescription:string>"

#: The schema that each record type is read with. Unknown types are passed over.
SCHEMAS = {
    "screen_ocr_observation": f"recordID string, capturedAt string, lastActivityAt string, content string, contentWasTruncated boolean, supersedingWriteAttemptID string, triggerSurface {SURFACE}, postCaptureSurface {SURFACE}, windowBounds {RECT}, windowTitle string, windowID bigint, displayID bigint, appName string, bundleIdentifier string, processIdentifier int",
    "active_tap_write_attempt": f"recordID string, beganAt string, lastInputAt string, observedAt string, terminalDecisionAt string, terminalSnapshotAt string, configuredWriteDelaySeconds double, processIdentifier int, conditioningState string, inputEventCount int, inputHints array<string>, inputEvents array<struct<hint:string,mutationCapable:boolean,eventTimestampNanoseconds:bigint>>, boundaryReason string, before {BEFORE}, after {OBSERVATION}, returnCheckpoints array<{CHECKPOINT}>, pasteCheckpoints array<{PASTE}>, mutationCheckpoints array<{CHECKPOINT}>, beforeAXErrors array<string>, afterAXErrors array<string>, lastEventTimestampNanoseconds bigint, tapTimeoutCountDuringBurst bigint, targetIdentity {TARGET}, bundleIdentifier string",
    "prompt_submission_observation": f"recordID string, observedAt string, sourceWriteRecordID string, terminalObservationID string, terminalValueSHA256 string, terminalCharacterCount int, referenceRetainedAt string, surfaceValidationErrors array<string>, action struct<kind:string,observedAt:string,matchedSubmissionTerm:string>, preActionObservation {OBSERVATION}, preActionAXErrors array<string>, postActionObservation {OBSERVATION}, postActionAXErrors array<string>, disposition string",
}


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, line, record_type, raw): the records of the files, one file a session's journal.

    line counts the non-empty lines of its file from 1. A line that is no JSON object is an error. Files are read by lines and in
    splits: a split's lines are numbered where they are read, and shifted by the lines of the file's splits before.
    """
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", "\r$", "")) != "")
    split = lines.select(F.regexp_replace("value", "\r$", "").alias("raw"), F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("split_"), F.monotonically_increasing_id().alias("mark_"))
    # kept, so that both uses below see the same numbers; marks grow along a split
    split = cut(split)
    sizes = split.groupBy("file_", "split_").agg(F.count("*").alias("n_"), F.min("mark_").alias("first_"))  # one row a split
    before = F.coalesce(F.sum("n_").over(W.partitionBy("file_").orderBy("split_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = split.join(sizes.withColumn("before_", before).drop("n_"), ["file_", "split_"]).withColumn("line", (F.col("mark_") - F.col("first_") + F.col("before_") + 1).cast("long"))
    kind = F.get_json_object("raw", "$.recordType")
    whole = F.get_json_object("raw", "$").startswith("{")
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("no JSON object in line "), F.col("line").cast("string"))))
    return placed.select(F.get_json_object("raw", "$.sessionID").alias("session_id"), "line", kind.alias("record_type"), checked.alias("raw"))


def records(journal: DataFrame, record_type: str) -> DataFrame:
    """One type's records with its schema's columns beside session_id and line."""
    rows = journal.where(F.col("record_type") == record_type)
    return rows.select("session_id", "line", F.from_json("raw", SCHEMAS[record_type]).alias("r")).select("session_id", "line", "r.*")


def instant(c: Column) -> Column:
    """ISO-8601 text as microseconds in UTC; null where it is none."""
    return F.unix_micros(F.try_to_timestamp(c))


def needed(journal: DataFrame, ids: DataFrame, id_column: str = "record_id") -> DataFrame:
    """The journal's records whose ID is asked for."""
    keyed = journal.withColumn(id_column, F.get_json_object("raw", "$.recordID"))
    return keyed.join(ids.select(id_column).distinct(), id_column, "left_semi")


def missing(journal: DataFrame, ids: DataFrame, id_column: str = "record_id") -> DataFrame:
    """IDs that no record has."""
    have = journal.select(F.get_json_object("raw", "$.recordID").alias(id_column))
    return ids.select(id_column).distinct().join(have, id_column, "left_anti")


def recover(rows: DataFrame, key: list[str], line: str) -> tuple[DataFrame, DataFrame]:
    """A journal that two writers raced on: the earliest row of each key, and the later ones apart."""
    ranked = rows.withColumn("rank_", F.row_number().over(W.partitionBy(*key).orderBy(line)))
    return ranked.where("rank_ = 1").drop("rank_"), ranked.where("rank_ > 1").drop("rank_")


def conflicting_sessions(journals: DataFrame) -> DataFrame:
    """Sessions that come with different bytes: (session_id, n_digests) for rows (session_id, digest)."""
    return journals.groupBy("session_id").agg(F.countDistinct("digest").alias("n_digests")).where("n_digests > 1")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, digest) of the files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def write_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """Canonical JSON lines in order: keys sorted, nulls left out. Refuses a path that exists."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    rows.orderBy(*order).select(body.alias("value")).write.mode("errorifexists").text(path)


def table_digest(rows: DataFrame) -> DataFrame:
    """(n_rows, digest): a digest of a table that neither order nor partitions change."""
    one = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256)
    parts = [F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = rows.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(parts)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", "n_rows", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def manifest(kind: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table: its name, rows and digest."""
    rows = [table_digest(t).select(F.lit(kind).alias("kind"), F.lit(name).alias("table"), "n_rows", "digest") for name, t in sorted(tables.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
