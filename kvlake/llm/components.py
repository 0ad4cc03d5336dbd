"""Connected components over a table of links, by label propagation with pointer jumping.

Nothing is collected: each round is a join and an aggregation whose result is written to the
shared folder, and only the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.shared import drop, keep


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, comp): comp is the smallest node that can be reached.

    Null ends and self links are ignored; repeated links do no harm; no links give no rows.
    Nodes without links are not in the result.
    """
    edges = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = keep(edges.select("u", "v").union(edges.select("v", "u")).dropDuplicates(), "edges")
    labels = keep(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("comp")), "labels")
    while True:
        of = labels.select(F.col("node").alias("v"), F.col("comp").alias("near"))
        heard = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = keep(lower.join(jump, "comp", "left").select("node", "was", F.coalesce(F.least("comp", "further"), "comp").alias("comp")), "labels")
        drop(labels)
        labels = after.select("node", "comp")
        labels.kept_path = after.kept_path
        if after.filter("comp <> was").isEmpty():
            drop(both)
            return labels
