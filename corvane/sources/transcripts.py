"""Readers of chat transcripts (JSON lines, two dialects), clippings and portable archives, tolerant of bad lines.

A file is one row (path, value), as spark.read.text(..., wholetext=True) gives it; everything else is expressions over
VARIANT values, so lines with other fields, or without some, are no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import strip_tagged
from corvane.operators.ingest import INJECTED_TAGS

#: Blocks that the second dialect injects, and the envelope of an observer's session.
ROLLOUT_TAGS = ["user_instructions", "environment_context"]
ENVELOPE = r"^\s*(Hello memory agent,[^\n]*\s+)?<observed_from_primary_session>"
BLOCKS = "array<struct<type:string,text:string>>"
OWNER = "owner"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _lines(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    return rows.select("path", "line", F.try_parse_json("raw").alias("v")).where("v is not null")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _joined(blocks: Column, kind: str, clean=lambda c: c) -> Column:
    kept = F.filter(blocks, lambda b: (b["type"] == kind) & b["text"].isNotNull())
    return F.array_join(F.transform(kept, lambda b: clean(b["text"])), "\n")


def _turns(rows: DataFrame) -> DataFrame:
    """rows (path, line, session_id, cwd, at, speaker, text, calls) -> turns of the sessions in which a person speaks.

    omitted: tool calls since the assistant's turn before; session_id and cwd are the first that a file names.
    """
    by_line = Window.partitionBy("path").orderBy("line")
    whole = by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("calls").over(by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in ("session_id", "cwd")})
    spoken = rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where((F.col("text") != "") & ((F.col("speaker") != OWNER) | ~F.col("text").rlike(ENVELOPE)))
    before = F.lag("total", 1, 0).over(Window.partitionBy("path", "speaker").orderBy("line"))
    spoken = spoken.withColumn("omitted", F.when(F.col("speaker") == OWNER, 0).otherwise(F.col("total") - before).cast("int"))
    spoken = spoken.withColumn("has_owner", F.max(F.col("speaker") == OWNER).over(Window.partitionBy("path"))).where("has_owner")
    return spoken.select("path", "session_id", "cwd", (F.row_number().over(by_line) - 1).alias("turn"), "speaker", "text", "omitted", "at")


def chat_turns(files: DataFrame) -> DataFrame:
    """First dialect: one entry per line, with type, message.content (a string or blocks) and flags of what isn't talk."""
    flagged = [F.coalesce(_get(f"$.{f}", "boolean"), F.lit(False)) for f in ("isMeta", "isSidechain", "isCompactSummary", "isApiErrorMessage")]
    rows = _lines(files).withColumn("type", _get("$.type")).where(F.col("type").isin("user", "assistant") & ~(flagged[0] | flagged[1] | flagged[2] | flagged[3]))
    listed = F.schema_of_variant(_get("$.message.content", "variant")).startswith("ARRAY")
    blocks = F.when(listed, _get("$.message.content", BLOCKS))
    clean = lambda c: strip_tagged(c, INJECTED_TAGS)
    person = F.when(listed, _joined(blocks, "text", clean)).otherwise(clean(_get("$.message.content")))
    is_person = F.col("type") == "user"
    return _turns(
        rows.select(
            "path", "line", _get("$.sessionId").alias("session_id"), _get("$.cwd").alias("cwd"), _get("$.timestamp").alias("at"), F.when(is_person, OWNER).otherwise("assistant").alias("speaker"),
            F.coalesce(F.when(is_person, person).otherwise(_joined(blocks, "text")), F.lit("")).alias("text"),
            F.when(is_person, 0).otherwise(F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == "tool_use")), F.lit(0))).alias("calls"),
        )
    )


def rollout_turns(files: DataFrame) -> DataFrame:
    """Second dialect: envelopes of type, timestamp and payload; calls are entries of their own."""
    rows = _lines(files).select("path", "line", "v", _get("$.type").alias("type"), _get("$.payload.type").alias("kind"), _get("$.payload.role").alias("role"))
    meta = F.col("type") == "session_meta"
    call = (F.col("type") == "response_item") & F.col("kind").isin("function_call", "custom_tool_call", "web_search_call")
    talk = (F.col("type") == "response_item") & (F.col("kind") == "message") & F.col("role").isin("user", "assistant")
    blocks, is_person = _get("$.payload.content", BLOCKS), F.col("role") == "user"
    text = F.when(is_person, strip_tagged(_joined(blocks, "input_text"), ROLLOUT_TAGS)).otherwise(_joined(blocks, "output_text"))
    return _turns(
        rows.where(meta | call | talk).select(
            "path", "line", F.when(meta, F.coalesce(_get("$.payload.id"), _get("$.payload.session_id"))).alias("session_id"), F.when(meta, _get("$.payload.cwd")).alias("cwd"), _get("$.timestamp").alias("at"),
            F.when(talk & is_person, OWNER).otherwise("assistant").alias("speaker"), F.when(talk, F.coalesce(text, F.lit(""))).otherwise("").alias("text"), F.when(call, 1).otherwise(0).alias("calls"),
        )
    )


def larger_files(files: DataFrame, roots: list[str]) -> DataFrame:
    """Of files of one name in several roots the largest, then the one of the later root."""
    rank = F.coalesce(*[F.when(F.contains("path", F.lit(r)), i) for i, r in enumerate(roots)], F.lit(-1))
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("size", F.length("value")).withColumn("root", rank)
    k = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("size"), F.desc("root"), "path"))
    return named.withColumn("k", k).where("k = 1").select("path", "value")


def clippings(files: DataFrame) -> DataFrame:
    """path, locator (SHA-256 of the content), url, title, selection, note: JSON where it parses, else all of it a note; blank ones don't come."""
    as_json = F.when(F.col("path").endswith(".json"), F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant(as_json).startswith("OBJECT"), F.lit(False))
    field = lambda c: F.when(is_object, F.try_variant_get(as_json, f"$.{c}", "string"))
    rows = files.select("path", F.sha2("value", 256).alias("locator"), field("url").alias("url"), field("title").alias("title"), field("selection").alias("selection"), F.when(is_object, field("note")).otherwise(F.col("value")).alias("note"))
    return rows.where(F.concat_ws("", *[F.regexp_replace(c, r"\s", "") for c in ("url", "title", "selection", "note")]) != "")


#: Fixed value: the shape of a portable archive.
ARCHIVE = (
    "format string, source_id string, source_key string, revision string, source struct<platform:string,conversation_id:string,title:string,project:string>, "
    "coverage struct<kind:string,completeness:string,from:timestamp,until:timestamp,limitations:array<string>,omissions:array<struct<reason:string,count:long>>>, "
    "messages array<struct<id:string,role:string,speaker:string,text:string,at:timestamp,fidelity:string>>, reflection struct<author:string,status:string,text:string,message_ordinals:array<int>>, "
    "relation struct<receipt_id:string,kind:string,note:string>, original struct<media_type:string,text:string>, broken string"
)


def archives(files: DataFrame) -> DataFrame:
    """path, a (the archive, null fields where it lacks them; broken holds text that isn't JSON)."""
    return files.select("path", F.from_json("value", ARCHIVE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("a"))


def archive_messages(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.col("a.source_key").alias("source_key"), F.posexplode("a.messages").alias("ordinal", "m")).select("path", "source_key", "ordinal", "m.*")
