"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded with their positions and hashed to 128 bits; documents are counted for each hash with map-side
partial sums, so a line that a third of all documents hold is one row a task.  The keys over the threshold are written
as a table and joined back to the lines: Spark splits skewed keys only in a join whose two sides are both dealt out for
it, which a side still being summed isn't.  A text is reassembled from the positions left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm import textcols
from veridex.llm.shared_store import written


def line_keys(text: Column, min_chars: int) -> Column:
    """128 bits for the key of each line, null for a key of fewer than min_chars code points."""

    def hashed(key: Column) -> Column:
        bits = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
        return F.when(F.length(key) >= min_chars, bits)

    # lower-cased as a whole and stripped in a step of its own, so that no line is brought to its key twice
    return F.transform(F.transform(textcols.lines(textcols.lower_ascii(text)), textcols.strip_blanks), hashed)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """One row for each row of docs: id_col, n_lines, n_dropped, text (what is left, joined by line ends).

    A line's key is the line without blanks at its ends and with A-Z lower-cased.  A key of at least min_chars code
    points that stands in at least min_docs documents loses its lines everywhere but in the largest id that holds it.
    A null or empty text is one empty line.  Documents are counted by id: rows that share one are one document, though each
    gives a row of the result; rows with the largest id all keep the line.  A null id is an id, smaller than any other.  An
    empty table gives no rows.  Other columns of docs are not read, so their names can't clash.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    source = source.withColumn("_row", F.xxhash64("_id", "_text"))
    keyed = source.select("_id", "_row", line_keys(F.col("_text"), min_chars).alias("_keys"))

    # sorted, so that equal keys of a document are neighbours: distinct structs would be compared all with all
    ordered = keyed.select("_id", F.sort_array(F.filter("_keys", lambda k: k.isNotNull())).alias("_keys"))
    distinct = F.filter("_keys", lambda k, i: (i == 0) | (k != F.get("_keys", i - 1)))
    held = ordered.select("_id", F.explode(distinct).alias("_key")).select("_id", "_key.a", "_key.b")
    if not source.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        held = held.distinct()  # rows that share an id are one document to be counted
    counted = held.groupBy("a", "b")
    shared = counted.agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper")).filter(F.col("_docs") >= min_docs)
    shared = written(shared.select("a", "b", "_keeper"))

    placed = keyed.select("_id", "_row", F.posexplode("_keys").alias("_pos", "_key")).filter(F.col("_key").isNotNull())
    placed = placed.select("_id", "_row", "_pos", "_key.a", "_key.b")
    lost = placed.join(shared, ["a", "b"]).filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
    lost = lost.groupBy(F.col("_row").alias("_lost_row"), F.col("_id").alias("_lost_id")).agg(F.collect_set("_pos").alias("_lost"))

    same = (F.col("_row") == F.col("_lost_row")) & F.col("_id").eqNullSafe(F.col("_lost_id"))
    joined = source.join(lost, same, "left").withColumn("_lines", textcols.lines(F.col("_text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    return joined.select(
        F.col("_id").alias(id_col),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.array_size("_lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(kept).alias("text"),
    )
