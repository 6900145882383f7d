"""Spans as small numbers: what changes from one to the next, with an exact inverse; and spans of other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("line", "col", "lines", "width")


def deltas(rows: DataFrame, key: str, order: str, span: str = "span") -> DataFrame:
    """rows with the span as four small integers: lines since the span before, its column, the lines it goes over, and its last column (since its first one, if on one line)."""
    start, end = F.col(f"{span}.start"), F.col(f"{span}.end")
    before = F.coalesce(F.lag(start["line"]).over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    lines = end["line"] - start["line"]
    return rows.withColumns({"line": start["line"] - before, "col": start["col"], "lines": lines, "width": F.when(lines == 0, end["col"] - start["col"]).otherwise(end["col"])}).drop(span)


def restored(rows: DataFrame, key: str, order: str, span: str = "span") -> DataFrame:
    """The inverse of `deltas`."""
    at = F.sum("line").over(Window.partitionBy(key).orderBy(order)).cast("int")
    place = lambda line, col: F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"))
    end = place(at + F.col("lines"), F.when(F.col("lines") == 0, F.col("col") + F.col("width")).otherwise(F.col("width")))
    return rows.withColumn(span, F.struct(place(at, F.col("col")).alias("start"), end.alias("end"))).drop(*COLUMNS)


def size(number: Column) -> Column:
    """Bytes of a number as a variable-length integer, seven bits a byte, its sign in the lowest."""
    zigzag = F.when(number < 0, -2 * number - 1).otherwise(2 * number)
    return F.when(zigzag == 0, 1).otherwise(F.ceil(F.length(F.bin(zigzag)) / 7)).cast("int")


def packed_size(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, plain_bytes, packed_bytes): four 32-bit integers a span, and what its deltas take."""
    total = F.sum(sum((size(F.col(c)) for c in COLUMNS), F.lit(0)))
    return rows.groupBy(key).agg(F.count("*").alias("n"), (16 * F.count("*")).alias("plain_bytes"), total.alias("packed_bytes"))


def unwrapped(span: Column, lines: int = 1) -> Column:
    """The span that a parser gives whose ends are closed, in a text that stands `lines` lines down in a wrapper: right-open, in the text itself."""
    place = lambda p, right: F.struct((p["line"] - lines).alias("line"), (p["col"] + right).alias("col"))
    return F.when(span.isNotNull(), F.struct(place(span["start"], 0).alias("start"), place(span["end"], 1).alias("end")))
