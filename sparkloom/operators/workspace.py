"""Reading a tree of files as rows: listing, slices of lines, search, compare-and-set writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import paths
from sparkloom.operators.lineage import cut

#: Every line end that a text splitter knows, as a Java expression.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final end makes no further line."""
    all_of = F.split(text, LINE_END, -1)
    return F.when(F.try_element_at(all_of, F.lit(-1)) == "", F.slice(all_of, F.lit(1), F.size(all_of) - 1)).otherwise(all_of)


def list_children(files: DataFrame, folder: str, by: str, limit: int = 500) -> DataFrame:
    """(by, name, type, truncated) of the direct children of ``folder`` in each tree, at most ``limit`` by name."""
    prefix = "" if folder in ("", ".") else folder.rstrip("/") + "/"
    inside = files.where(F.col("path").startswith(prefix) & ~paths.is_unsafe("path"))
    rest = F.expr(f"substring(path, {len(prefix) + 1})")
    child = inside.select(by, F.substring_index(rest, "/", 1).alias("name"), F.instr(rest, "/").alias("slash"))
    child = child.where(~paths.is_sensitive(F.concat(F.lit(prefix), F.col("name"))))
    kinds = child.groupBy(by, "name").agg(F.when(F.max("slash") > 0, "directory").otherwise("file").alias("type"))
    # the filter on the row number keeps ``limit`` rows of each tree before anything is moved
    first = kinds.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("name"))).where(F.col("_n") <= limit)
    return first.select(by, "name", "type", (F.max("_n").over(Window.partitionBy(by)) >= limit).alias("truncated"))


def line_slice(df: DataFrame, text: str, start: int, end: int | None) -> DataFrame:
    """``df`` with slice, start_line, end_line, line_count and sha256 of the whole text."""
    n = F.size("_l")
    stop = n if end is None else F.least(n, F.lit(end))
    first = max(1, start)
    out = df.withColumn("_l", lines(text)).withColumn("line_count", n).withColumn("start_line", F.lit(first)).withColumn("end_line", stop)
    return out.withColumn("slice", F.array_join(F.slice("_l", F.lit(first), F.greatest(F.col("end_line") - first + 1, F.lit(0))), "\n")).withColumn("sha256", F.sha2(text, 256)).drop("_l")


def search(df: DataFrame, key: str, text: str, query: str, regex: bool = False, limit: int = 200, width: int = 500) -> DataFrame:
    """(key, line, text) of the first ``limit`` lines that match, by key and line; the order makes it a top-k, not a sort."""
    each = df.select(key, F.posexplode(lines(text)).alias("line", "text"))
    hit = each.where(F.col("text").rlike(query) if regex else F.contains("text", F.lit(query)))
    return hit.select(key, (F.col("line") + 1).alias("line"), F.substring("text", 1, width).alias("text")).orderBy(key, "line").limit(limit)


def compare_and_set(current: DataFrame, writes: DataFrame, order: str | None = None) -> DataFrame:
    """(path, ok, sha256) of each write (path, content, expected_sha256): done only if the stored content is the expected
    one (null: no file); otherwise the digest that is stored afterwards comes back.

    All writes of a batch expect the state before it, so at most one for each path is done: the first, by ``order`` (a column
    of ``writes``; by content where none is given), whose expectation holds. Writes to one path are not gathered: the
    first is an aggregate.
    """
    now = current.select("path", F.sha2("content", 256).alias("_now"))
    numbered = cut(writes.withColumn("_id", F.monotonically_increasing_id()))  # numbers must not change between the reads
    both = numbered.join(now, "path", "left").withColumn("_new", F.sha2("content", 256))
    fits = F.col("_now").eqNullSafe(F.col("expected_sha256"))
    rank = F.struct(*([F.col(order)] if order else []), "_new", "_id")
    won = both.where(fits).groupBy("path").agg(F.min(rank).alias("_won"))
    out = both.join(won, "path", "left")
    ok = F.coalesce(fits & (F.col("_won._id") == F.col("_id")), F.lit(False))
    return out.select("path", ok.alias("ok"), F.coalesce("_won._new", "_now").alias("sha256"))
