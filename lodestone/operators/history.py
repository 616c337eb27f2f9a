"""Version history: aligning changed lines with symbols, and matching old with new symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of a bucket of the range join.
LINES = 64


def align_lines(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """The smallest span around each changed line (path, line, breadcrumb); ties go to the smaller breadcrumb.

    ``changes``: path, line. ``spans``: path, start_line, end_line, breadcrumb. Lines and spans meet by buckets
    of lines, so the join is on equal keys and no file's lines meet all its spans. Of equal spans only the smallest
    breadcrumb goes on, so repeated ones cost no more than their reading; none of the inputs has to be distinct.
    """
    spans = spans.groupBy("path", "start_line", "end_line").agg(F.min("breadcrumb").alias("breadcrumb"))
    changes = changes.select("path", "line").distinct()
    bucket = lambda c: F.floor(c / F.lit(LINES)).cast("long")
    cells = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start_line")), bucket(F.col("end_line")))))
    hit = changes.withColumn("bucket", bucket(F.col("line"))).join(cells, ["path", "bucket"]).filter("line between start_line and end_line")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("length"), "breadcrumb"))
    return hit.groupBy("path", "line").agg(best.alias("best")).select("path", "line", F.col("best.breadcrumb").alias("breadcrumb"))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_name, new_name, change) for the symbols of a file before and after.

    Both need path, breadcrumb, body_key, start_line. Equal breadcrumbs are modified; of the rest equal bodies are
    renamed, one to one by position; what is left was added or deleted.
    """
    o, n = (x.select("path", F.col("breadcrumb").alias(f"{p}_name"), F.col("body_key").alias(f"{p}_body"), F.col("start_line").alias(f"{p}_line")) for x, p in ((old, "old"), (new, "new")))
    kept = o.join(n, (o.path == n.path) & (o.old_name == n.new_name)).select(o.path, "old_name", "new_name", F.lit("modified").alias("change"))
    o2 = o.join(kept.select("path", "old_name"), ["path", "old_name"], "left_anti")
    n2 = n.join(kept.select("path", "new_name"), ["path", "new_name"], "left_anti")
    nth = lambda p: F.row_number().over(Window.partitionBy("path", "body").orderBy(f"{p}_line", f"{p}_name"))
    a = o2.withColumnRenamed("old_body", "body").withColumn("nth", nth("old"))
    b = n2.withColumnRenamed("new_body", "body").withColumn("nth", nth("new"))
    change = F.when(F.col("old_name").isNull(), "added").when(F.col("new_name").isNull(), "deleted").otherwise("renamed")
    rest = a.join(b, ["path", "body", "nth"], "full_outer").select("path", "old_name", "new_name", change.alias("change"))
    return kept.unionByName(rest)
