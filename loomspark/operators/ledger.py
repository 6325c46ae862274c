"""Token estimates, history, packing and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"


def estimate_light(text: Column) -> Column:
    """int(cjk / 1.5 + other / 4)."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.floor(cjk / 1.5 + (F.length(text) - cjk) / 4.0).cast("long")


def estimate_safe(text: Column) -> Column:
    """The larger of cjk + ceil(other / 4) and ceil(bytes / 4), 1 at least."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.greatest(F.lit(1), cjk + F.ceil((F.length(text) - cjk) / 4.0), F.ceil(F.octet_length(text) / 4.0)).cast("long")


def budget_fold(rows: DataFrame, group: str, order: str, asked: str, budget: int, most: int) -> DataFrame:
    """Each group's requests in order: a grant is what was asked, at most `most` and at most what is left. A request
    with nothing left fails and takes nothing. -> (group, granted, refused, left)."""
    requests = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(asked).cast("long").alias("a"))))
    begin = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).cast("long").alias("granted"), F.lit(0).cast("long").alias("refused"))

    def step(acc: Column, x: Column) -> Column:
        grant = F.least(x["a"], F.lit(most).cast("long"), acc["left"])
        return F.struct((acc["left"] - grant).alias("left"), (acc["granted"] + grant).alias("granted"), (acc["refused"] + F.when(acc["left"] == 0, 1).otherwise(0).cast("long")).alias("refused"))

    return rows.groupBy(group).agg(F.aggregate(requests, begin, step).alias("s")).select(group, "s.granted", "s.refused", "s.left")
