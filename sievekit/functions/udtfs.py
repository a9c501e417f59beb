"""Python table functions for records whose rows are not known before they are parsed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class EquationEdges:
    """``left members <=> right members`` to one row per (left, right) pair.

    Members stand between `` + ``, may carry a coefficient and blanks, and a side may be empty: a null
    equation, one without ``<=>`` or with an empty side gives no rows."""

    def eval(self, equation: str):
        left, arrow, right = (equation or "").partition("<=>")
        if not arrow:
            return
        sides = [[part for part in map(self.member, side.split(" + ")) if part] for side in (left, right.split("<=>")[0])]
        for a in sides[0]:
            for b in sides[1]:
                yield a, b

    @staticmethod
    def member(text: str) -> str:
        words = text.strip().split(None, 1)
        return words[1] if len(words) == 2 else "".join(words)


equation_edges = F.udtf(EquationEdges, returnType="src string, dst string")


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: ``... , LATERAL equation_edges(column)``."""
    spark.udtf.register("equation_edges", equation_edges)
