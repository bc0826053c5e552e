"""Pages for people and machines: clippings, reminders, snapshots, drafts in replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.dates import local_date
from corvane.functions.text import clip

OWNER, ZONE = "owner", "America/Los_Angeles"
DRAFT = "title string, raw string, body string, type string"


def _line(prefix: str, value: Column) -> Column:
    there = F.coalesce(F.trim(value) != "", F.lit(False))
    return F.when(there, F.concat(F.lit(prefix), value)).otherwise("")


def clipping(rows: DataFrame) -> DataFrame:
    """rows (captured_at, app, device, title, url, selection, note) -> with raw and spans (array of struct(quote, start, end, speaker)).

    Title and address are context; only the selection, which is someone else's, and the owner's note are quotes.
    """
    end = lambda c: F.when(c != "", F.concat(c, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("clipping"), _line(" at ", F.col("captured_at")), _line(" from ", F.col("app")), _line(" on ", F.col("device")), F.lit("\n"), end(_line("title: ", F.col("title"))), end(_line("url: ", F.col("url"))))
    rows = rows.withColumn("raw", head).withColumn("spans", F.array().cast("array<struct<quote:string,start:int,end:int,speaker:string>>"))
    for label, speaker in (("selection", F.lit(None).cast("string")), ("note", F.lit(OWNER))):
        there, at = F.coalesce(F.trim(label) != "", F.lit(False)), F.length("raw") + len(label) + 3
        span = F.struct(F.col(label).alias("quote"), at.alias("start"), (at + F.length(label)).alias("end"), speaker.alias("speaker"))
        rows = rows.withColumns({"spans": F.when(there, F.concat("spans", F.array(span))).otherwise(F.col("spans")), "raw": F.when(there, F.concat("raw", F.lit(f"\n{label}:\n"), label, F.lit("\n"))).otherwise(F.col("raw"))})
    return rows


def reminder_line(due_at: Column, title: Column, kind: Column) -> Column:
    day = F.when(due_at.isNotNull(), F.concat(local_date(due_at, ZONE), F.lit(f" {ZONE}"))).otherwise("unscheduled")
    return F.concat(F.lit("- "), day, F.lit("  "), title, F.lit("  ("), F.coalesce(kind, F.lit("untyped")), F.lit(")"))


def snapshot(nodes: DataFrame, group: str, order: str, title: str, raw: str, most: int, whole: int) -> DataFrame:
    """group, page: its nodes in order as one text. Nodes are clipped before they are gathered, and the page is."""
    entry = F.concat(F.lit("### "), title, F.lit("\nraw: "), clip(F.col(raw), most))
    page = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" nodes.\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))), lambda x: x["e"]), "\n"))
    return nodes.groupBy(group).agg(page.alias("page")).select(group, clip(F.col("page"), whole).alias("page"))


def drafts(reply: Column) -> Column:
    """The drafts in a reply's fenced blocks: JSON objects with a title and raw words; the body falls back to these."""
    blocks = F.regexp_extract_all(reply, F.lit(r"(?s)```node\s*(.*?)```"), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.from_json(F.when(F.try_parse_json(b).isNotNull(), b), DRAFT))
    good = F.filter(parsed, lambda p: p.isNotNull() & (F.coalesce(F.trim(p["title"]), F.lit("")) != "") & (F.coalesce(F.trim(p["raw"]), F.lit("")) != ""))
    body = lambda p: F.when(F.coalesce(F.trim(p["body"]), F.lit("")) != "", p["body"]).otherwise(p["raw"])
    return F.transform(good, lambda p: F.struct(F.trim(p["title"]).alias("title"), p["raw"].alias("raw"), body(p).alias("body"), p["type"].alias("type")))
