"""Incremental ingestion: rendering with spans, new turns, ledgers, validation, chunking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chunker: ceiling and floor of a span, and the marker that starts a block.
MOST_CHARS, LEAST_CHARS, MARKER = 1500, 500, r"\[\d+:\d{2}:\d{2}\]"
INJECTED_TAGS = ["system-reminder", "local-command-caveat", "local-command-stdout", "command-message", "command-name", "command-args", "task-notification"]


def render(turns: DataFrame) -> DataFrame:
    """turns (session, turn, speaker, text, omitted) -> with start and end of each text in its session's rendered page.

    A page is "speaker:\\ntext\\n\\n" for each turn, with a line for the tool calls left out before it.
    """
    marker = F.when(F.col("omitted") > 0, F.concat(F.lit("["), F.col("omitted"), F.when(F.col("omitted") == 1, " tool call").otherwise(" tool calls"), F.lit(" omitted]\n\n"))).otherwise("")
    prefix = F.concat(marker, "speaker", F.lit(":\n"))
    size = F.length(prefix) + F.length("text") + 2
    before = F.coalesce(F.sum(size).over(Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("piece", F.concat(prefix, "text", F.lit("\n\n"))).withColumn("start", before + F.length(prefix)).withColumn("end", F.col("start") + F.length("text"))


def pages(rendered: DataFrame) -> DataFrame:
    parts = rendered.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("parts"))
    page = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    return parts.select("session", F.substring(page, F.lit(1), F.length(page) - 2).alias("raw"))


def new_turns(found: DataFrame, stored: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of found beyond those stored: as many of a key as stored has are taken off, the first ones in order."""
    nth = lambda df, by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    return nth(found, order).join(nth(stored, key).select(*key, "nth"), [*key, "nth"], "left_anti").drop("nth")


def latest_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("k", k).where("k = 1").drop("k")


def receipt_outcome(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """requests (request_id, digest), receipts (request_id, digest) -> request_id, outcome: stored, replayed or conflict."""
    known = receipts.select("request_id", F.col("digest").alias("known"))
    outcome = F.when(F.col("known").isNull(), "stored").when(F.col("known") == F.col("digest"), "replayed").otherwise("conflict")
    return requests.join(known, "request_id", "left").select("request_id", outcome.alias("outcome"))


def span_issues(spans: DataFrame) -> DataFrame:
    """spans (doc, start, end, quote, raw) -> with issues: out of order, overlapping, or not what the text says."""
    last = F.lag("end").over(Window.partitionBy("doc").orderBy("start", "end"))
    checks = F.array(
        F.when(F.col("end") <= F.col("start"), "empty_or_reversed"), F.when(F.col("start") < last, "overlaps"),
        F.when(F.substring("raw", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quote"), "quote_differs"),
    )
    return spans.withColumn("issues", F.array_compact(checks))


def excluded(text: Column, thread: Column, kind: Column, value: Column) -> Column:
    """A thread exclusion looks at the thread, every other kind at the whole text; letters' case doesn't count."""
    return F.when(kind == "thread", F.contains(F.lower(thread), F.lower(value))).otherwise(F.contains(F.lower(text), F.lower(value)))


def chunk(text: str) -> list[tuple[int, int]]:
    """Spans of a transcript: blocks begin at time markers, are cut at blanks over MOST_CHARS and joined up to it; a short tail joins the span before."""
    borders = [0, *(m.start() for m in re.finditer(MARKER, text) if m.start()), len(text)]
    blocks: list[tuple[int, int]] = []
    for lo, hi in zip(borders, borders[1:]):
        while hi - lo > MOST_CHARS:
            blank = max((m.end() for m in re.finditer(r"\s", text[lo + 1 : lo + MOST_CHARS])), default=None)
            at = lo + MOST_CHARS if blank is None else lo + 1 + blank
            blocks.append((lo, at))
            lo = at
        if hi > lo:
            blocks.append((lo, hi))
    spans: list[tuple[int, int]] = []
    for lo, hi in blocks:
        if spans and hi - spans[-1][0] <= MOST_CHARS:
            spans[-1] = (spans[-1][0], hi)
        else:
            spans.append((lo, hi))
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < LEAST_CHARS:
        tail = spans.pop()
        spans[-1] = (spans[-1][0], tail[1])
    return [(a, b) for a, b in spans if text[a:b].strip()]


def chunk_transcripts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, lo, hi, t[lo:hi]) for i, t in zip(b[id_col], b[text_col]) if t for k, (lo, hi) in enumerate(chunk(t))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk", "start", "end", "text"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} long, chunk long, start long, end long, text string")


def validate_transfer(archives: DataFrame) -> DataFrame:
    """archives (key, kind, completeness, limitations, from_at, until_at, has_original, message_ids, ordinals) -> key, issues."""
    ids = F.array_compact("message_ids")
    checks = F.array(
        F.when((F.col("kind") == "model_assembled") & (F.col("completeness") == "complete"), "assembly_not_complete"),
        F.when((F.col("kind") == "model_assembled") & (F.size("limitations") == 0), "limitations_missing"),
        F.when(F.col("has_original") & (F.col("kind") != "source_export"), "original_needs_export"), F.when(F.col("from_at") > F.col("until_at"), "dates_reversed"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "message_ids_repeat"), F.when(F.exists("ordinals", lambda o: o >= F.size("message_ids")), "ordinal_out_of_range"),
    )
    return archives.select("key", F.array_compact(checks).alias("issues"))
