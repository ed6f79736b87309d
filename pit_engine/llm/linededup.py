"""Line deduplication by windows of lines, in DataFrame functions only.

A window starts at each line with words and reaches to the line in which its
``min_words``-th word stands; another one ends at each line and reaches back as
far. Every line of a run of at least ``min_words`` words lies in a window inside
the run. A window's fingerprint is the hash of all its lines, so texts with one
fingerprint share the whole window (96 bits of two hash functions tell other
windows apart). Every window is joined to the earliest
position of its fingerprint, a star however often it occurs: whatever other
texts share only a part of it, that position holds all of it. Windows with one
source and offset are united to runs, with the blank lines between and around
them, and the runs are deleted. The earliest copy of a window is never deleted.

"Earlier" is by doc_id (null last), then by the text's hash, then by line.

Defined cases
  null text                kept as null; no lines
  empty text, blank lines  a blank line has no words; it is deleted only inside a run
  lines                    end at a line feed; blanks, tabs and carriage returns at
                           either end don't count for equality
  very long texts          whole; the work per line is bounded by a window
  repeated rows            rows with equal doc_id and text are one document and
                           get the same result; none of them is dropped
  nothing left             the text is empty, the row stays
  null ids                 as above
  empty table              no rows
  extra columns            kept as they are, whatever their names; the added column is the last
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pit_engine.llm.store import fresh_names, materialize

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k (doc_id, text hash), h and c (hashes of each line), w (words of each line); one row for equal rows."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.struct(F.col(id_col).cast("bigint").alias("id"), _hash(F.col(text_col)).alias("th")).alias("k"), _lines(F.col(text_col)).alias("lines"))
    h = F.transform("lines", lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r"))))
    c = F.transform("lines", lambda x: F.hash(F.btrim(x, F.lit(" \t\r"))))
    w = F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+")))
    return rows.select("k", h.alias("h"), c.alias("c"), w.alias("w"))


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, key, mark (of the key), first, last (line numbers), c0, c1 (words before and up to the end), gb, ga (blank lines before and after): all windows."""
    each = lines.select("k", F.size("h").alias("n"), F.posexplode(F.arrays_zip("h", "c", "w")).alias("p", "x")).select("k", "n", "p", "x.h", "x.c", "x.w").where("w > 0").distinct()
    along = Window.partitionBy("k").orderBy("p")
    placed = each.withColumn("c1", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("c0", F.col("c1") - F.col("w")).withColumn("gb", F.col("p") - F.coalesce(F.lag("p").over(along), F.lit(-1)) - 1)
    placed = placed.withColumn("ga", F.coalesce(F.lead("p").over(along), F.col("n")) - F.col("p") - 1)
    # The blank lines before a line count as part of it, but for a window's first line.
    placed = placed.withColumn("g", F.struct(F.xxhash64("h", "gb").alias("h"), "c"))
    ahead = Window.partitionBy("k").orderBy("c0").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("k").orderBy("c1").rangeBetween(1 - min_words, 0)
    place = F.struct("p", "c0", "c1", "gb", "ga", "h", "c")

    def window(first: Column, last: Column, inner: Column, needed: Column) -> Column:
        ends = [first["p"].alias("first"), last["p"].alias("last"), first["c0"].alias("c0"), last["c1"].alias("c1"), first["gb"].alias("gb"), last["ga"].alias("ga")]
        whole = needed & (last["c1"] - first["c0"] >= min_words)
        rest = F.slice(inner, F.lit(2), F.size(inner))
        return F.when(whole, F.struct(F.xxhash64(first["h"], rest).alias("key"), F.hash(first["c"], rest).alias("mark"), *ends))

    framed = placed.select("k", place.alias("x"), F.last(place).over(ahead).alias("l"), F.collect_list("g").over(ahead).alias("lg"), F.first(place).over(back).alias("f"), F.collect_list("g").over(back).alias("fg"))
    # A window back is not needed if the window ahead from its first line is the same.
    windows = F.array(window(F.col("x"), F.col("l"), F.col("lg"), F.lit(True)), window(F.col("f"), F.col("x"), F.col("fg"), F.col("x.c0") - F.col("f.c0") >= min_words))
    return framed.select("k", F.explode(windows).alias("z")).where("z is not null").select("k", "z.*")


def _order(k: str, p: str) -> Column:
    """Position as a value that sorts by "earlier"."""
    return F.struct(F.col(f"{k}.id").isNull().alias("n"), F.col(k).alias("k"), F.col(p).alias("p"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, first, last (line numbers), words, source (k), source_first: later repeated runs."""
    prints = materialize(fingerprints(line_table(docs, id_col, text_col), min_words), "fingerprints")
    earliest = F.min_by(F.struct("k", "first", "c0", "gb", "ga"), _order("k", "first"))
    firsts = prints.groupBy("key", "mark").agg(earliest.alias("o"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("key", "mark", F.col("o.k").alias("s"), F.col("o.first").alias("q"), F.col("o.c0").alias("sc"), F.col("o.gb").alias("sgb"), F.col("o.ga").alias("sga"))
    matches = prints.join(firsts, ["key", "mark"]).where(~(F.col("k").eqNullSafe(F.col("s")) & (F.col("first") == F.col("q"))))
    # Windows at one offset in lines and in words, and without words between them, have equal lines between them.
    spans = matches.select(
        "k",
        "s",
        (F.col("first") - F.col("q")).alias("shift"),
        (F.col("c0") - F.col("sc")).alias("words_shift"),
        (F.col("first") - F.least("gb", "sgb")).alias("first"),
        (F.col("last") + F.least("ga", "sga")).alias("last"),
        "c0",
        "c1",
    )
    aligned = ["k", "s", "shift", "words_shift"]
    along = Window.partitionBy(*aligned).orderBy("c0", "c1")
    fresh = F.col("c0") > F.coalesce(F.max("c1").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    island = spans.withColumn("new", fresh.cast("int")).withColumn("g", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy(*aligned, "g").agg(F.min("first").alias("first"), F.max("last").alias("last"), (F.max("c1") - F.min("c0")).alias("words"))
    return runs.select("k", "first", "last", "words", F.col("s").alias("source"), (F.col("first") - F.col("shift")).alias("source_first"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without later repeated runs, and a last column: the deleted line numbers.

    That column is ``_dropped``, or has a name like it that ``docs`` doesn't use.
    """
    i, t, gone = fresh_names(docs, "_id", "_th", "_dropped")
    runs = repeated_runs(docs, min_words, id_col, text_col)
    dropped = runs.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("lines"))
    dropped = dropped.select(F.col("k.id").alias(i), F.col("k.th").alias(t), F.col("lines").alias(gone))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(i)) & (_hash(F.col(text_col)) == F.col(t))
    joined = docs.join(dropped, same & F.col(text_col).isNotNull(), "left")
    lines = _lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda n: F.get(lines, n)), "\n"))
    return joined.withColumn(text_col, text).drop(i, t)
