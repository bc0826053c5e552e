"""The read tools that a client calls by name: each gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import optional_table, table


class Reader:
    """Tools over the tables of one folder. Unknown tools and arguments are refused, optional tables may be absent."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tools = {"node": self.node, "edges": self.edges, "recall": self.recall, "status": self.status}

    def call(self, tool: str, arguments: dict) -> DataFrame:
        if tool not in self.tools:
            raise ValueError(f"no tool named {tool}")
        return self.tools[tool](**arguments)

    def node(self, ids: list[int]) -> DataFrame:
        return table(self.spark, self.sf_dir, "customer").where(F.col("c_custkey").isin(ids))

    def edges(self, node: int) -> DataFrame:
        return table(self.spark, self.sf_dir, "orders").where(F.col("o_custkey") == node)

    def recall(self, question: str, k: int = 10) -> DataFrame:
        """The documents that answer one question best, by the fused text lanes."""
        from corvane.operators import lanes as L
        from corvane.operators import postings as P
        from corvane.operators import rank as R

        asked = self.spark.createDataFrame([(0, question)], "qid long, text string")
        hits = P.question_hits(table(self.spark, self.sf_dir, "documents"), "doc_id", "text", P.query_terms(asked), 24)
        return R.top_fused(R.fuse(L.text_lanes(hits, 24, {"and": 1.0, "or": 0.6})), k).select("id", "rrf", "fused_rank")

    def status(self) -> DataFrame:
        """How many rows each layer has; null for one that isn't there."""
        rows = [(n, None if (t := optional_table(self.spark, self.sf_dir, n)) is None else t.count()) for n in ("documents", "pages", "embeddings")]
        return self.spark.createDataFrame(rows, "layer string, rows long")
