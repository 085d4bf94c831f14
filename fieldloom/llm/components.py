"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import checkpoint, tidy

#: Links for each task that writes or reads them, and such tasks at least.
TASK_LINKS, LEAST_TASKS = 1 << 16, 8


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of longs to (u, v): v is the least number that u reaches; nodes that are least are left out.

    Every round joins the links with each node's least neighbour, a grouped minimum, so a node with a
    large share of the links is pre-aggregated in the one and split as a skewed key in the other.
    Rounds grow as the logarithm of the longest chain. Null ends and loops are dropped.

    Links never grow in number from round to round, so once they are counted, what reads them and what writes them
    runs in as many tasks as they need, whatever the session's number is: tables of a few thousand links in
    hundreds of parts cost a round thousands of tasks, shuffle files and checkpoint files.
    """
    e = checkpoint(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    if not before[0]:
        return e
    tasks = max(LEAST_TASKS, -(-before[0] // TASK_LINKS))
    e = e.coalesce(tasks)
    while True:
        back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = e.select("u", "v").unionByName(back).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = back.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        # Both ends of a link go to the least end of its larger one.
        e = e.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        e = checkpoint(e.coalesce(tasks))
        now = _state(e)
        if now == before:
            del back, low
            tidy(e.sparkSession)
            return e
        before = now
