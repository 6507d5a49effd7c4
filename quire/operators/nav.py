"""Navigation trees: from heading levels, walked, flattened, cleaned of targets that don't exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tree_from_levels(rows: DataFrame, key: str, order: str = "ord", level: str = "level") -> DataFrame:
    """rows with parent (the order of the nearest earlier row of a smaller level) and depth. Levels are 1 to 3,
    so two running windows decide; a row whose level has nothing above it is a root."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda most: F.last(F.when(F.col(level) <= most, F.col(order)), ignorenulls=True).over(w)
    out = rows.withColumns({"_one": last(1), "_two": last(2)})
    parent = F.when(F.col(level) == 2, F.col("_one")).when(F.col(level) >= 3, F.col("_two"))
    two_has_one = F.last(F.when(F.col(level) <= 2, F.when(F.col(level) == 1, 1).when(F.col("_one").isNotNull(), 2).otherwise(1)), ignorenulls=True).over(w)
    out = out.withColumn("parent", parent)
    depth = F.when(F.col("parent").isNull(), 1).when(F.col(level) == 2, 2).otherwise(two_has_one + 1)
    return out.withColumn("depth", depth.cast("int")).drop("_one", "_two")


def preorder(nav: DataFrame) -> DataFrame:
    """nav (book_id, node_id, parent_id, sib_ord) with path (numbers of siblings from the root), depth and pre_ord."""
    nav.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # as many rows as nodes, not a million
    nav.createOrReplaceTempView("_quire_nav")
    paths = nav.sparkSession.sql(
        "WITH RECURSIVE t (book_id, node_id, path) AS ("
        " SELECT book_id, node_id, array(sib_ord) FROM _quire_nav WHERE parent_id IS NULL"
        " UNION ALL SELECT n.book_id, n.node_id, concat(t.path, array(n.sib_ord)) FROM _quire_nav n"
        " JOIN t ON n.book_id = t.book_id AND n.parent_id = t.node_id) SELECT * FROM t"
    )
    own = nav.drop(*[c for c in ("path", "depth", "pre_ord") if c in nav.columns]).join(paths, ["book_id", "node_id"])
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("path"))
    return own.withColumns({"depth": F.size("path"), "pre_ord": number})


def promoted(nav: DataFrame, targets: DataFrame) -> DataFrame:
    """nav without nodes whose target isn't among targets (book_id, target); their children move to the nearest
    ancestor that stays. Takes nav with path (see preorder); a node meets its ancestors by the beginnings of its path."""
    good = nav.join(targets.select("book_id", "target").distinct().withColumn("_ok", F.lit(True)), ["book_id", "target"], "left")
    kept = good.where("_ok").drop("_ok")
    up = kept.select("book_id", F.col("node_id").alias("_up"), F.col("path").alias("_path"))
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))
    mine = kept.where(F.size("path") > 1).select("book_id", "node_id", F.explode(above).alias("_path"))
    above = mine.join(up, ["book_id", "_path"])
    nearest = above.groupBy("book_id", "node_id").agg(F.max_by("_up", F.size("_path")).alias("parent_id"))
    return kept.drop("parent_id").join(nearest, ["book_id", "node_id"], "left")


def chapter_levels(nav: DataFrame) -> DataFrame:
    """book_id, target, level: the least depth of a chapter's entries without anchor, 1 to 3."""
    own = nav.where(F.col("anchor").isNull() | (F.col("anchor") == ""))
    return own.groupBy("book_id", "target").agg(F.greatest(F.lit(1), F.least(F.lit(3), F.min("depth"))).alias("level"))


def depth(nav: DataFrame) -> DataFrame:
    return nav.groupBy("book_id").agg(F.max("depth").alias("depth"))


def flat_nav(chapters: DataFrame) -> DataFrame:
    """A root entry for each titled chapter."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    t = chapters.where(F.col("title").isNotNull()).withColumn("sib_ord", n)
    return t.select(
        "book_id", F.concat(F.lit("n"), "sib_ord").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("depth"),
        "sib_ord", F.col("sib_ord").alias("pre_ord"), "title", F.col("chapter_id").alias("target"), F.lit(None).cast("string").alias("anchor"), "level",
    )


def numbered(prefix: str, order: Column, *keys: str, width: int = 0) -> Column:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0") if width else n)
