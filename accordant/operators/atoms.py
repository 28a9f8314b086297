"""Shared-exclusions information atoms of label columns: what two labels say about a third, together and each alone.

Rows are counted by cell first, with partial sums before the exchange; all
marginals are sums over the cells, and the atoms one aggregate of them. The
size of everything after the first count is that of the distinct cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATOMS = ("i_x", "i_y", "i_xy", "redundancy", "unique_x", "unique_y", "synergy")


def atoms(rows: DataFrame, x: str, y: str, target: str) -> DataFrame:
    """One row, in bits: informations i_x, i_y, i_xy of the target; redundancy, unique_x, unique_y and synergy.

    Redundancy is that of the event "this x or this y": it may be negative, as
    in an exclusive or. The four atoms add up to i_xy. Nulls are a label of
    their own; repeated rows count each. An empty table gives nulls.
    """
    cells = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y"), F.col(target).alias("t")).agg(F.count("*").alias("n_xyt"))
    over = {"".join(k): F.sum("n_xyt").over(Window.partitionBy(*k)) for k in (("x",), ("y",), ("t",), ("x", "y"), ("x", "t"), ("y", "t"))}
    marginals = cells.withColumns({f"n_{k}": total for k, total in over.items()})
    n = cells.agg(F.sum("n_xyt").alias("n"))  # one row
    told = marginals.crossJoin(F.broadcast(n))
    mean = lambda text: F.expr(f"sum(n_xyt / n * log2({text}))")
    out = told.agg(
        mean("n_xt * n / (n_x * n_t)").alias("i_x"),
        mean("n_yt * n / (n_y * n_t)").alias("i_y"),
        mean("n_xyt * n / (n_xy * n_t)").alias("i_xy"),
        mean("(n_xt + n_yt - n_xyt) * n / (n_t * (n_x + n_y - n_xy))").alias("redundancy"),
    )
    alone = {"unique_x": F.col("i_x") - F.col("redundancy"), "unique_y": F.col("i_y") - F.col("redundancy")}
    return out.withColumns(alone | {"synergy": F.col("i_xy") - F.col("i_x") - F.col("i_y") + F.col("redundancy")})
