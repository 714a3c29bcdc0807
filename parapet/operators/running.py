"""Running values over long ordered sequences, without one task per key.

A plain window sorts a whole key in one task. Here each key is cut into blocks of positions: a
window inside the block, a summary row per block, and a window over the summaries only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.session import spread

BLOCK = 4096


def running(df: DataFrame, keys: list[str], pos: str, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Add running sums and last non-null values up to and including each row.

    ``sums`` / ``lasts`` map a new column to the SQL expression it runs over; ``pos`` must be unique
    inside a key.
    """
    sums, lasts = sums or {}, lasts or {}
    x = df.withColumn("_b", F.expr(f"cast(floor({pos} / {block}) as bigint)"))
    x = x.select("*", *[F.expr(e).alias(f"_s_{n}") for n, e in sums.items()], *[F.expr(e).alias(f"_l_{n}") for n, e in lasts.items()])
    summary = x.groupBy(*keys, "_b").agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
        *[F.expr(f"max_by(_l_{n}, {pos}) filter (where _l_{n} is not null)").alias(f"_e_{n}") for n in lasts],
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in lasts],
    )
    upto = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inner = x.select(
        "*",
        *[F.sum(f"_s_{n}").over(upto).alias(f"_r_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(upto).alias(f"_q_{n}") for n in lasts],
    )
    j = inner.join(spread(offsets), [*keys, "_b"])
    return j.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.coalesce(f"_r_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"_q_{n}", f"_p_{n}").alias(n) for n in lasts],
    )
