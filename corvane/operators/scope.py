"""The scope of a question, and the plan that a question with or without a known anchor follows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.dates import in_range

#: Fixed values.
LAYERS, ROLES = ("all", "nodes", "evidence"), ("user", "assistant", "system", "tool", "other", "unknown")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})")
PLAN = ["exact_lookup", "lexical_search", "semantic_seed", "resolve_entity", "graph_expand", "inspect_evidence", "classify_epistemic_state", "choose_authorized_action"]
ANCHORED = [s for s in PLAN if s not in ("lexical_search", "semantic_seed", "resolve_entity")]


def _instant(text: str | None) -> datetime | None:
    if text is None:
        return None
    if not _INSTANT.fullmatch(text):
        raise ValueError("invalid scope: an instant needs a zone and at most six digits of a second")
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)


@dataclass(frozen=True)
class Scope:
    """Layer, source, role and closed bounds; a source or a role means evidence. Bounds are exact to the microsecond."""

    layer: str = "all"
    source_id: str | None = None
    role: str | None = None
    start: datetime | None = None
    until: datetime | None = None

    @staticmethod
    def of(layer: str = "all", source_id: str | None = None, role: str | None = None, start: str | None = None, until: str | None = None) -> Scope:
        if layer not in LAYERS or (role is not None and role not in ROLES) or (source_id is not None and not _UUID.fullmatch(source_id)):
            raise ValueError("invalid scope")
        lo, hi = _instant(start), _instant(until)
        if (lo and hi and lo > hi) or (layer == "nodes" and (source_id or role)):
            raise ValueError("invalid scope")
        return Scope("evidence" if source_id or role else layer, source_id and source_id.lower(), role, lo, hi)

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows (layer: node or evidence, source_id, role, at) inside the scope; meant to stand before any ranking."""
        if self.layer != "all":
            rows = rows.where(F.col("layer") == {"nodes": "node", "evidence": "evidence"}[self.layer])
        for column, value in (("source_id", self.source_id), ("role", self.role)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        if self.start or self.until:
            bound = lambda x: F.lit(x).cast("timestamp")
            rows = rows.where(F.col("at").isNotNull() & in_range(F.col("at"), bound(self.start), bound(self.until), closed=True))
        return rows


def plan(has_anchor: bool, most_steps: int = 8) -> list[str]:
    return (ANCHORED if has_anchor else PLAN)[: max(0, int(most_steps))]
