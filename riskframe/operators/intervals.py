"""Line ranges: merging, ownership among nested callables, containment and overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import round2
from riskframe.runtime import Scratch

BIN = 64  # lines per bin of the interval joins
OWNER_BIN = 256  # lines per bin of the ownership sweep


def merge_ranges(ranges: DataFrame, by: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Overlapping and adjacent ranges of each group as one. Ranges that end before they start are left out."""
    r = ranges.where(F.col(start) <= F.col(end)).select(*by, F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    order = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = r.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    return (
        starts.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "island")
        .agg(F.min("s").alias(start), F.max("e").alias(end))
        .drop("island")
    )


def owned_ranges(callables: DataFrame, key: str = "id", file: list[str] | None = None) -> DataFrame:
    """The lines each callable owns (not held by a nested one) as ranges: file, id, start_line, end_line.

    A line belongs to the deepest callable over it, then to the one with the earlier start byte, end byte, smaller key. Owners
    change only where a callable starts or has ended, so that the plan works on these boundaries and not on lines: each
    boundary takes the first of the callables over it (met by file and bin of lines, aggregated inside each task before
    the shuffle), and neighbouring boundaries with one owner become one range. No window spans more than the
    boundaries of one bin, the bins of one file, or the boundaries of one callable.
    """
    by = file or ["file"]
    bin_of = lambda c: F.floor(c / OWNER_BIN).cast("int")
    c = callables.where(F.col("start_line") <= F.col("end_line")).select(*by, "start_line", "end_line", F.struct((-F.col("depth")).alias("depth"), "start_byte", "end_byte", F.col(key).alias("id")).alias("rank"))
    edge = c.select(*by, F.explode(F.array("start_line", F.col("end_line") + 1)).alias("at")).distinct().withColumn("bin", bin_of(F.col("at")))
    bins = edge.groupBy(*by, "bin").agg(F.min("at").alias("at"))
    after = bins.select(*by, "bin", F.lead("at").over(Window.partitionBy(*by).orderBy("bin")).alias("beyond"))
    inner = edge.withColumn("next", F.lead("at").over(Window.partitionBy(*by, "bin").orderBy("at")))
    segments = inner.join(after, [*by, "bin"]).select(*by, "bin", "at", F.coalesce("next", "beyond").alias("next"))
    over = c.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start_line")), bin_of(F.col("end_line")))))
    held = over.join(segments, [*by, "bin"]).where("at between start_line and end_line")
    owner = held.groupBy(*by, "at", "next").agg(F.min("rank").alias("rank")).select(*by, "at", "next", F.col("rank.id").alias("id"))
    along = Window.partitionBy(*by, "id").orderBy("at")
    starts = owner.withColumn("new", (F.coalesce(F.lag("next").over(along), F.lit(-1)) != F.col("at")).cast("int"))
    islands = starts.withColumn("island", F.sum("new").over(along))
    return islands.groupBy(*by, "id", "island").agg(F.min("at").alias("start_line"), (F.max("next") - 1).alias("end_line")).drop("island")


def covered_percent(spans: DataFrame, owned: DataFrame, file: list[str] | None = None) -> DataFrame:
    """Coverage of each callable from the spans that lie wholly in one of its owned ranges: id, coverage_percent.

    The spans in a range are those that end by its last line, less those that start before its first, plus those that start
    before it and end behind it. Each of the three is read off running sums over the lines of a file (``_points`` and
    ``_lookups``), so that spans and ranges never meet pair by pair. Equal spans are summed first and written once. Running
    sums go over one bin of lines and, from bin to bin, over one file. Without statements coverage is null.
    """
    by, sums, row = file or ["file"], ["n", "hit", "all"], ["sign", "size", "level", "block"]
    s = _placed(spans, by, F.when(F.col("covered"), F.col("statements")).otherwise(0).alias("hit"), F.col("statements").alias("all"))
    s = s.groupBy(*by, "s", "e").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hit", "all")])
    s = Scratch(spans.sparkSession, "coverage").cut(s)
    points, sizes = _points(s, by, sums)
    asked = _lookups(_placed(owned, by, "id"), sizes, by)
    lines = points.unionByName(asked, allowMissingColumns=True).withColumn("bin", F.floor(F.col("line") / BIN))
    along = Window.partitionBy(*by, *row, "bin").orderBy("line", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by, *row).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = lines.groupBy(*by, *row, "bin").agg(*[F.sum(c).alias(c) for c in sums]).select(*by, *row, "bin", *[F.sum(c).over(before).alias(f"{c}_before") for c in sums])
    inner = lines.select(*by, *row, "bin", "id", "asks", *[F.sum(c).over(along).alias(c) for c in sums]).where("asks")
    upto = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_before", F.lit(0))) for c in sums]
    total = inner.join(bins, [*by, *row, "bin"]).groupBy("id").agg(*[F.sum(F.col("sign") * x).alias(c) for c, x in zip(sums, upto, strict=True)]).where("n > 0")
    return total.select("id", F.when(F.col("all") > 0, round2(F.col("hit").cast("double") * 100.0 / F.col("all"))).alias("coverage_percent"))


def _placed(df: DataFrame, by: list[str], *cols) -> DataFrame:
    """Rows whose file and lines are known, with the lines as s and e."""
    known = df.where(" and ".join(f"`{c}` is not null" for c in (*by, "start_line", "end_line")))
    return known.select(*by, F.col("start_line").cast("long").alias("s"), F.col("end_line").cast("long").alias("e"), *cols)


def _at(sign: str, size: str, level: str, block: str, line: str) -> str:
    return f"named_struct('sign', {sign}, 'size', {size}, 'level', {level}, 'block', {block}, 'line', {line})"


def _points(s: DataFrame, by: list[str], sums: list[str]) -> tuple[DataFrame, DataFrame]:
    """The places of each span in the rows of running sums, and the sizes of each file's spans: files, sizes.

    Size 0 holds the ends (sign 1) and the starts (sign -1). Spans of three lines or more also stand under their size, the
    whole part of the binary logarithm of their length, once per level 0 to size: in the block of 2^level lines in which they
    start, at their end counted backwards. Spans that end before they start have a negative size and stand one line wider on both
    sides, as a range that does so too holds those that reach its lines, not only those that reach beyond them.
    """
    wide = s.select(*by, *sums, "s", "e", F.expr("if(e < s, e - 1, s) as lo"), F.expr("if(e < s, s + 1, e) as hi")).withColumn("log", F.expr("length(bin(hi - lo + 1)) - 1"))
    wide = wide.withColumn("as_size", F.expr("if(e < s, -log, log)"))
    own = f"if(hi - lo < 2, array(), transform(sequence(0, log), x -> {_at('1', 'as_size', 'x', 'shiftright(lo, x)', '-hi')}))"
    points = wide.select(*by, *sums, F.lit(False).alias("asks"), F.expr(f"inline(concat(array({_at('1', '0', '0', '0L', 'e')}, {_at('-1', '0', '0', '0L', 's')}), {own}))"))
    return points, wide.where("hi - lo >= 2").groupBy(*by).agg(F.collect_set("as_size").alias("sizes"))


def _lookups(ranges: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """The places whose running sums make up what each range holds.

    Spans around a range are looked up for the sizes of its file that can hold it and a line more on either side. Those of one size
    that reach the range start in its first line's block of 2^size lines or in the two blocks before; the lines of the
    first block before the range are at most one block of each lower level.
    """
    r = ranges.join(sizes, by, "left").select(*by, "id", "s", "e", "sizes", F.expr("e < s as turned"), F.least("s", "e").alias("first"), F.greatest("s", "e").alias("last"))
    r = r.withColumn("sizes", F.expr("filter(coalesce(sizes, array()), x -> (x < 0) = turned and abs(x) >= length(bin(last - first + 3)) - 1)"))
    whole = ", ".join(_at("1", "x", "abs(x)", f"shiftright(first, abs(x)) - {k}", "-last - 1") for k in (1, 2))
    parts = f"transform(filter(sequence(0, abs(x) - 1), y -> shiftright(first, y) & 1 = 1), y -> {_at('1', 'x', 'y', 'shiftright(first, y) - 1', '-last - 1')})"
    plain = f"if(turned, array(), array({_at('1', '0', '0', '0L', 'e')}, {_at('-1', '0', '0', '0L', 's - 1')}))"
    return r.select(*by, "id", F.lit(True).alias("asks"), F.expr(f"inline(concat({plain}, flatten(transform(sizes, x -> concat(array({whole}), {parts})))))"))


def overlaps(callables: DataFrame, ranges: DataFrame, file: list[str] | None = None, key: str = "id") -> DataFrame:
    """Keys of the callables that overlap any changed range, once each."""
    by = file or ["file"]
    cut = lambda df, *cols: df.where("start_line <= end_line").select(*by, *cols, "start_line", "end_line", F.explode(F.sequence((F.col("start_line") / BIN).cast("int"), (F.col("end_line") / BIN).cast("int"))).alias("bin"))
    c = cut(callables, F.col(key).alias("id"))
    r = cut(ranges).withColumnRenamed("start_line", "rs").withColumnRenamed("end_line", "re")
    return c.join(r, (c["bin"] == r["bin"]) & (F.col("start_line") <= F.col("re")) & (F.col("rs") <= F.col("end_line")) & _same(c, r, by), "left_semi").select("id").distinct()


def _same(a, b, by):
    cond = F.lit(True)
    for k in by:
        cond = cond & (a[k] == b[k])
    return cond
