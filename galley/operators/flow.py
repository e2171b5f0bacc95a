"""Operators on spans, lines and elements of a page: styles and runs, streams of elements, running heads, rows of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley import tunables as K
from galley.functions import text as T
from galley.functions.geometry import Box
from galley.operators import sequence as S

#: Columns of a span that make its style, beside its size to two decimals.
STYLE = ("font", "colour", "bold", "italic", "mono", "serif", "sup", "link", "dest", "tracked")


def style_key(taken: list[str]) -> Column:
    """The style of a span as a struct: what neighbours must share to be one run. Columns that a table lacks are null."""
    return F.struct(F.round("size", 2).alias("size"), *[F.col(c).alias(c) if c in taken else F.lit(None).cast("string").alias(c) for c in STYLE])


def runs(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, run, style, text, n): neighbouring spans of one style as one run; repeated spaces are one, except in a fixed pitch."""
    styled = spans.withColumn("style", style_key(spans.columns))
    made = S.islands(styled, keys, [order], lambda prev: prev("style").isNotNull() & ~F.col("style").eqNullSafe(prev("style")), "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "")
    one = made.groupBy(*keys, "run").agg(F.min("style").alias("style"), text.alias("text"), F.count("*").alias("n"))
    return one.withColumn("text", F.when(F.coalesce(F.col("style.mono").cast("boolean"), F.lit(False)), F.col("text")).otherwise(F.regexp_replace("text", " {2,}", " ")))


def rotated(dir_y: str = "dir_y") -> Column:
    return F.abs(F.coalesce(F.col(dir_y), F.lit(0.0))) >= K.ROTATED


def split_rotated(lines: DataFrame, blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of the flow, rotated lines, and the blocks that still have a line of the flow."""
    flow = lines.where(~rotated())
    return flow, lines.where(rotated()), blocks.join(flow.select(*keys).distinct(), keys, "left_semi")


def bullet_blocks(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Drawn marks (x0, y0, x1, y1, size) as blocks of text of one bullet, on the baseline of the text that they mark."""
    return marks.select(*keys, F.lit("block").alias("kind"), F.lit("•").alias("text"), "x0", "y0", "x1", "y1", F.col("y1").alias("baseline"), "size")


def element_stream(*streams: DataFrame, keys: list[str]) -> DataFrame:
    """Streams of elements (kind, x0, y0 and more) of all kinds as one, with their place in reading order."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    return all_.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.bround("y0", 1), "x0", "kind")))


def without_consumed(rows: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no element has taken."""
    return rows.join(consumed.select(*keys).distinct(), keys, "left_anti")


def labelled(glyphs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs (gid, g_x1, g_y0, g_y1) with the leftmost line (lid, x0, y0, y1) that begins right of it, near, at its height. Keys hold a page and a band of heights."""
    near = glyphs.join(lines, keys).where((F.col("x0") - F.col("g_x1") > 0) & (F.col("x0") - F.col("g_x1") <= K.LABEL_REACH))
    middle = (F.col("g_y0") + F.col("g_y1")) / 2
    return near.where(middle.between(F.col("y0"), F.col("y1"))).groupBy(*keys, "gid").agg(F.min(F.struct("x0", "lid"))["lid"].alias("lid"))


def running_heads(lines: DataFrame, doc: list[str], page: str, page_h: float) -> DataFrame:
    """(doc, zone, y3, sig, n_pages): lines of the top and bottom zones that recur on enough pages, by masked text and height."""
    zone = F.when(F.col("y1") <= K.TOP_ZONE, "top").when(F.col("y0") >= page_h - K.BOTTOM_ZONE, "bottom")
    sig = F.substring(T.digits_masked(F.col("text")), 1, 40)
    total = lines.groupBy(*doc).agg(F.count_distinct(page).alias("__n"))
    found = lines.withColumn("zone", zone).where("zone is not null").groupBy(*doc, "zone", F.bround(F.col("y0") / 3, 0).alias("y3"), sig.alias("sig")).agg(F.count_distinct(page).alias("n_pages"))
    needed = F.greatest(F.lit(K.REPEAT_LEAST), F.bround(K.REPEAT_SHARE * F.col("__n"), 0))
    return found.join(total, doc).where(F.col("n_pages") >= needed).drop("__n")


def table_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, n_rows, n_columns, top, bottom): runs of baselines with several cells at small pitch, whose columns recur."""
    rows = lines.groupBy(*keys, "baseline").agg(F.count("*").alias("cells"), F.array_sort(F.collect_set(F.bround(F.col("x0") / K.COLUMN_TOL, 0))).alias("xs")).where("cells >= 2")
    made = S.islands(rows, keys, ["baseline"], lambda prev: F.col("baseline") - prev("baseline") > K.ROW_PITCH, "grp")
    by_column = made.select(*keys, "grp", F.explode("xs").alias("x")).groupBy(*keys, "grp", "x").agg(F.count("*").alias("n")).where(F.col("n") >= K.TABLE_ROWS)
    columns = by_column.groupBy(*keys, "grp").agg(F.count("*").alias("n_columns")).where(F.col("n_columns") >= K.TABLE_COLUMNS)
    groups = made.groupBy(*keys, "grp").agg(F.count("*").alias("n_rows"), F.min("baseline").alias("top"), F.max("baseline").alias("bottom")).where(F.col("n_rows") >= K.TABLE_ROWS)
    return groups.join(columns, [*keys, "grp"])


def alignment(lines: DataFrame, keys: list[str], col_l: float, col_r: float) -> DataFrame:
    """(keys, align, n_lines, indent, first_indent) of paragraphs of lines (x0, x1, seq) in a column."""
    mid = (F.col("x0") + F.col("x1")) / 2
    spread = lambda c: F.max(c) - F.min(c)
    last = F.max_by(F.col("x1"), F.col("seq"))
    p = lines.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), spread(mid).alias("__mid"), spread(F.col("x0")).alias("__l"), F.min("x0").alias("__x0"), F.max("x1").alias("__x1"), F.min_by("x0", "seq").alias("__first"),
        F.array_sort(F.collect_list(F.struct("seq", "x1"))).alias("__ends"), last.alias("__last"),
    )
    inner = F.transform(F.slice("__ends", F.lit(1), F.greatest(F.lit(1), F.col("n_lines") - 1)), lambda e: e["x1"])
    flush_r = F.array_max(inner) - F.array_min(inner) <= K.ALIGN_EDGE
    at_left = F.col("__x0") - col_l <= K.ALIGN_EDGE
    one = F.when((F.col("__x0") - col_l > K.ONE_LINE_CENTRE) & (col_r - F.col("__x1") > K.ONE_LINE_CENTRE) & (F.abs((F.col("__x0") + F.col("__x1")) / 2 - (col_l + col_r) / 2) <= K.ALIGN_CENTRE), "center").when(
        (F.col("__x0") - col_l > K.ONE_LINE_RIGHT) & (col_r - F.col("__x1") <= K.ALIGN_EDGE), "right"
    )
    many = (
        F.when((F.col("__mid") <= K.ALIGN_CENTRE) & ~at_left, "center").when((F.col("n_lines") >= 3) & flush_r & (F.col("__l") <= K.ALIGN_EDGE), "justify")
        .when((F.col("n_lines") == 2) & (col_r - F.array_max(inner) <= K.ALIGN_EDGE) & (F.col("__l") <= K.ALIGN_EDGE), "justify").when((col_r - F.col("__x1") <= K.ALIGN_EDGE) & ~at_left, "right")
    )
    align = F.coalesce(F.when(F.col("n_lines") == 1, one).otherwise(many), F.lit("left"))
    return p.select(*keys, align.alias("align"), "n_lines", (F.col("__x0") - col_l).alias("indent"), (F.col("__first") - F.col("__x0")).alias("first_indent"))


def may_relax_bottom(pages: DataFrame, figures: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """pages (margin_b, page_h) with relax: no element but a figure reaches into the bottom margin, and some figure does."""
    low = lambda df, name: df.join(pages.select(*keys, "margin_b", "page_h"), keys).where(F.col("y1") > F.col("page_h") - F.col("margin_b")).groupBy(*keys).agg(F.lit(True).alias(name))
    met = pages.join(low(figures, "__f"), keys, "left").join(low(elements, "__e"), keys, "left")
    return met.withColumn("relax", F.col("__f").isNotNull() & F.col("__e").isNull()).drop("__f", "__e")


def font_fit(runs_: DataFrame, metrics: DataFrame) -> DataFrame:
    """runs_ (family, mean_width) with the replacement of least deviation in width from a table of families (candidate, width): a specification."""
    listed = F.broadcast(metrics.agg(F.array_sort(F.collect_list(F.struct("candidate", "width"))).alias("__m")))
    best = F.array_min(F.transform("__m", lambda m: F.struct(F.abs(m["width"] - F.col("mean_width")).alias("deviation"), m["candidate"].alias("candidate"))))
    return runs_.join(listed).withColumn("__b", best).select(*runs_.columns, F.col("__b.candidate").alias("replacement"), F.col("__b.deviation").alias("deviation"))


def padded(images: DataFrame, keys: list[str]) -> DataFrame:
    """Images (keys, side, w, h, px: rows of grey values) on the common canvas of the sides of their keys, filled with 255."""
    common = Window.partitionBy(*keys)
    big = images.withColumns({"__w": F.max("w").over(common), "__h": F.max("h").over(common)})
    white = lambda n: F.array_repeat(F.lit(255), n)
    row = lambda r: F.concat(F.coalesce(F.get("px", r), F.array().cast("array<int>")), white(F.when(r < F.col("h"), F.col("__w") - F.col("w")).otherwise(F.col("__w"))))
    filled = big.withColumn("__px", F.transform(F.sequence(F.lit(0), (F.col("__h") - 1).cast("int")), row))  # by itself: a select's aliases would be seen in the lambda
    return filled.select(*keys, "side", F.col("__w").alias("w"), F.col("__h").alias("h"), F.col("__px").alias("px"))


def billing(elements: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """elements (eid, e_x0 ...) with the number of lines whose centre they hold and the height that these take."""
    box = Box.of("e_")
    held = elements.join(lines, keys).where(box.holds((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2))
    return held.groupBy(*keys, "eid").agg(F.count("*").alias("n_lines"), F.sum(F.col("y1") - F.col("y0")).alias("inked"), (F.max("y1") - F.min("y0")).alias("span"))


def cover_band(fills: DataFrame, keys: list[str], page_w: float) -> DataFrame:
    """(keys, height, n): the bottom of the chain of wide fills that begins at the top of a page, where it is high enough."""
    wide = fills.where((F.col("x1") - F.col("x0") >= K.BAND_WIDE * page_w) & (F.col("y1") - F.col("y0") >= K.BAND_HIGH) & (F.col("y0") <= K.BAND_TOP))
    upto = F.max("y1").over(Window.partitionBy(*keys).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    cut = wide.withColumn("upto", upto).withColumn("gap", F.when(F.col("upto").isNull(), F.col("y0") > K.BAND_FIRST).otherwise(F.col("y0") > F.col("upto") + K.BAND_NEXT).cast("int"))
    chain = cut.withColumn("gaps", F.sum("gap").over(Window.partitionBy(*keys).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, 0))).where("gaps = 0")
    return chain.groupBy(*keys).agg(F.max("y1").alias("height"), F.count("*").alias("n")).where(F.col("height") > K.BAND_LEAST)
