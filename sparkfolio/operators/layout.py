"""Pages of boxes into problems: cuts, columns, anchors, assignment, gaps, lines. A page is the key of every shuffle.

Frames have (page, ord, kind, x1, y1, x2, y2, txt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

BOX = ["x1", "y1", "x2", "y2"]
# Header words that are never an anchor.
NOT_ANCHORS = r"(?i)(지선다형|단답형|서답형|홀수형|짝수형|수학\s*영역|제\s*\d+\s*교시)"
# Words of page footers.
FOOTER_WORDS = ("확인 사항", "담당자", "답안지", "선택과목", "기입", "표기", "문제지", "자신이 선택한", "제시되었")

# Number and mark at the start; the same after up to three other characters; a lone number; a heading.
NUMBER_RULES = (r"^\s*(\d{1,3})\s*[.．):]\s*", r"^[^\d]{0,3}(\d{1,3})\s*[.．):]\s*", r"^\s*(\d{1,3})\s*$", r"^\s*#*\s*(\d{1,3})\s*$")
WIDE_CHARS = "".join(map(chr, range(0xFF10, 0xFF1A))) + "）．：＃" + "⁰¹²³⁴⁵⁶⁷⁸⁹"
PLAIN_CHARS = "0123456789).:#" + "0123456789"


def anchor(text: Column) -> Column:
    """The question number a block begins with, null without one (or for 0, which numbers no question)."""
    return F.nullif(_number(text, NUMBER_RULES), F.lit(0))


def _number(text: Column, rules: tuple[str, ...]) -> Column:
    """The number of the first rule that the whole text meets, or else of the first line that is a number or a heading.

    Full-width and raised digits and marks count as plain ones.
    """
    t = F.translate(T.trim_ws(F.coalesce(text, F.lit(""))), WIDE_CHARS, PLAIN_CHARS)
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in rules])
    line = F.nullif(F.regexp_extract(t, r"(?m)^[ \t]*#*[ \t]*(\d{1,3})[ \t]*$", 1), F.lit(""))
    return F.coalesce(found, line).cast("int")


def dedup_grid(blocks: DataFrame) -> DataFrame:
    """The first block of each kind, text and place on a grid of 2 pixels."""
    key = [F.col("page"), F.col("kind"), F.col("txt"), *(F.expr(f"{c} div 2") for c in BOX)]
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))).where("rank = 1").drop("rank")


def _header_bottom() -> Column:
    return F.max(F.when(F.col("kind").isin("title", "sub_title", "header"), F.col("y2")))


def _first_anchor_top() -> Column:
    return F.min(F.when((F.col("kind") == "text") & anchor(F.col("txt")).isNotNull(), F.col("y1")))


def _top_cut(low: Column, first: Column, height: int) -> Column:
    cut = F.least(low + 8, first - 18)
    return F.when(cut.isNotNull(), F.least(cut, F.lit(int(height * 0.15))).cast("int")).otherwise(0)


def top_cut(blocks: DataFrame, height: int) -> DataFrame:
    """(page, y_cut): under the headers and above the first anchor, at most 15 % of the page; 0 without either."""
    found = blocks.groupBy("page").agg(_header_bottom().alias("low"), _first_anchor_top().alias("first"))
    return found.select("page", _top_cut(F.col("low"), F.col("first"), height).alias("y_cut"))


def with_page_cut(blocks: DataFrame, height: int, sat: bool = False) -> DataFrame:
    """Adds y_cut: the top cut, or 8 % of a page that has none, but not in SAT mode."""
    least, page = F.lit(0 if sat else max(1, int(height * 0.08))), Window.partitionBy("page")
    rows = blocks.where("page is not null").withColumns({"low": _header_bottom().over(page), "first": _first_anchor_top().over(page)})
    cut = _top_cut(F.col("low"), F.col("first"), height)
    return rows.withColumn("y_cut", F.when(cut <= 0, least).otherwise(cut)).drop("low", "first")


def without_margins(blocks: DataFrame, height: int, bottom: float = 0.80, sat: bool = False) -> DataFrame:
    """Blocks, with their page's y_cut, between the top cut (8 % of the page where there is none, but not in SAT mode) and the bottom ratio, without footers."""
    digits = F.length(F.regexp_replace("txt", "[^0-9]", ""))
    footer = (F.col("y1") > height * 0.6) & (F.col("txt").rlike("|".join(FOOTER_WORDS)) | F.col("txt").rlike(r"^[○•*]"))
    number = F.col("txt").rlike(r"^\s*\d{1,2}\s*[\s/–-]\s*\d{1,3}\s*$")
    scrap = (F.col("y1") > height * 0.82) & (F.length("txt") < 10) & (digits / F.greatest(F.lit(1), F.length("txt")) > 0.6)
    keep = (F.col("y1") < height * 0.3) | (F.col("kind") != "text") | ((F.col("txt") != "") & ~footer & ~number & ~scrap)
    kinds = ~F.col("kind").isin("title", "header") & ~((F.col("kind") == "sub_title") & F.col("txt").rlike(NOT_ANCHORS))
    return with_page_cut(blocks, height, sat).where((F.col("y1") >= F.col("y_cut")) & (F.col("y1") < height * bottom) & keep & kinds)


def columns(blocks: DataFrame, width: int) -> DataFrame:
    """Adds col: 0 left, 1 right of the middle; a narrow dead zone goes right; a page with one side only is cut at the middle itself."""
    centre, middle, zone = (F.col("x1") + F.col("x2")) * 0.5, 0.5 * width, int(width * 0.003)
    side = F.when(centre < middle - zone, 0).when(centre > middle + zone, 1).otherwise(F.when(centre >= middle * 0.99, 1).otherwise(0))
    page = Window.partitionBy("page")
    right = F.sum("side").over(page)
    alone = (right == 0) | (right == F.count(F.lit(1)).over(page))
    return blocks.withColumn("side", side).withColumn("col", F.when(alone, F.when(centre < middle, 0).otherwise(1)).otherwise(F.col("side"))).drop("side")


def uncovered(new: DataFrame, old: DataFrame, share: float = 0.25) -> DataFrame:
    """Boxes of new that no box of old on their page overlaps by `share` of either's area."""
    b = old.select("page", *(F.col(c).alias("o" + c) for c in BOX)).alias("b")
    a_box, b_box = [F.col(c) for c in BOX], [F.col("o" + c) for c in BOX]
    hit = (G.overlap_share(a_box, b_box) >= share) | (G.overlap_share(b_box, a_box) >= share)
    return new.join(b.withColumnRenamed("page", "opage"), (F.col("page") == F.col("opage")) & hit, "left_anti")


def assigned(blocks: DataFrame, tolerance: int = 8) -> DataFrame:
    """(page, col, ord, anchor_ord, qnum): each block goes to the first anchor whose stretch, widened by the tolerance, holds its top.

    blocks need col. Blocks above the first anchor are left out; anchors go to themselves.
    """
    kinds = F.col("kind").isin("text", "sub_title", "equation") & ~F.col("txt").rlike(NOT_ANCHORS)
    order = Window.partitionBy("page", "col").orderBy("y1", "x1", "ord")
    marked = blocks.withColumn("qnum", F.when(kinds, anchor(F.col("txt")))).withColumn("seq", F.row_number().over(order))
    anchors = marked.where("qnum is not null").select("page", "col", F.col("ord").alias("anchor_ord"), "qnum", F.col("y1").alias("top"), F.col("seq").alias("anchor_seq"))
    anchors = anchors.withColumn("below", F.lead("top", 1, 1_000_000_000).over(Window.partitionBy("page", "col").orderBy("anchor_seq")))
    near = (F.col("y1") >= F.col("top") - tolerance) & (F.col("y1") < F.col("below") + tolerance)
    mine = F.when(F.col("own").isNotNull(), F.col("ord") == F.col("anchor_ord")).otherwise(near)
    rows = marked.select("page", "col", "ord", "y1", F.col("qnum").alias("own")).join(anchors, ["page", "col"]).where(mine)
    first = F.row_number().over(Window.partitionBy("page", "col", "ord").orderBy("anchor_seq"))
    return rows.withColumn("rank", first).where("rank = 1").select("page", "col", "ord", "anchor_ord", "qnum")


def grouped(blocks: DataFrame, tolerance: int = 8) -> DataFrame:
    """blocks with col, plus anchor_ord and qnum: the question of each block, its first block being the anchor.

    As assigned(), and: a column without an anchor takes the number of its first text, or is question 1 as a whole, or
    goes if it has no text. Where numbers are missing between an anchor and the next one, the anchor's other blocks are cut
    at the widest gaps, a part a number, if there are enough; not so in a column where most anchors are headings.
    Blocks above a first anchor of more than 1 are cut likewise into the questions before it.
    """
    column = ["page", "col"]
    order, whole = Window.partitionBy(*column).orderBy("y1", "x1", "ord"), Window.partitionBy(*column)
    kinds = F.col("kind").isin("text", "sub_title", "equation") & ~F.col("txt").rlike(NOT_ANCHORS)
    rows = blocks.withColumns({"own": F.when(kinds, anchor(F.col("txt"))), "seq": F.row_number().over(order)})
    text_seq = F.min(F.when(F.col("kind").isin("text", "sub_title") & (F.col("txt") != ""), F.col("seq"))).over(whole)
    rows = rows.withColumns({"n_own": F.count("own").over(whole), "text_seq": text_seq})
    strict = F.coalesce(_number(F.col("txt"), (NUMBER_RULES[0], *NUMBER_RULES[2:])), F.lit(-1))
    rows = rows.withColumn("said", F.max(F.when(F.col("seq") == F.col("text_seq"), strict)).over(whole))
    lone = F.when((F.col("said") >= 0) & (F.col("seq") == F.col("text_seq")), F.col("said")).when((F.col("said") < 0) & (F.col("seq") == 1), 1)
    rows = rows.withColumn("own", F.when(F.col("n_own") > 0, F.col("own")).otherwise(lone))
    heads = F.count(F.when(F.col("own").isNotNull() & (F.col("kind") == "sub_title"), 1)).over(whole)
    total = F.count("own").over(whole)
    rows = rows.withColumn("fills", (heads <= 1) | (heads < F.floor(total / 2))).drop("n_own", "text_seq", "said")

    # A column's anchors in their order, beside each of its blocks: the first that takes a block is picked without a join.
    own = F.when(F.col("own").isNotNull(), F.struct(F.col("seq").alias("anchor_seq"), F.col("ord").alias("anchor_ord"), F.col("own").alias("qnum"), F.col("y1").alias("top"), "fills"))
    rows = rows.withColumn("anchors", F.array_sort(F.collect_list(own).over(whole)))

    def taken(x: Column, i: Column) -> Column:
        after = F.get("anchors", i + 1)
        near = (F.col("y1") >= x["top"] - tolerance) & (F.col("y1") < F.coalesce(after["top"], F.lit(1_000_000_000)) + tolerance)
        above = (i == 0) & (F.col("y1") < x["top"] - tolerance) & (x["qnum"] > 1)
        mine = F.when(F.col("own").isNotNull(), F.col("ord") == x["anchor_ord"]).otherwise(near | above)
        parts = F.when(x["fills"] & (after["qnum"] - x["qnum"] > 1), after["qnum"] - x["qnum"]).otherwise(1)
        return F.when(mine, F.struct(x["anchor_seq"].alias("anchor_seq"), x["anchor_ord"].alias("anchor_ord"), x["qnum"].alias("qnum"), parts.alias("parts"), (F.col("own").isNull() & above).alias("above")))

    first = F.get(F.filter(F.transform("anchors", taken), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.where("page is not null").withColumn("first", first).where("first is not null").drop("fills", "anchors").select("*", "first.*").drop("first")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*column, "ord").orderBy("anchor_seq"))).where("rank = 1")

    # A part of an anchor's blocks: its own block, those to be cut by missing numbers, those above.
    part = F.when(F.col("own").isNotNull(), 0).when(F.col("above"), 1).otherwise(2)
    asked = F.when(F.col("above"), F.col("qnum") - 1).otherwise(F.col("parts"))
    keys = [*column, "anchor_ord", "part"]
    rows = rows.withColumn("part", part).withColumn("asked", F.when(F.col("part") == 0, 1).otherwise(asked))
    few = (F.col("part") == 2) & (F.count(F.lit(1)).over(Window.partitionBy(*keys)) < 2)
    rows = gap_segments(rows.withColumn("asked", F.when(few, 1).otherwise(F.col("asked"))), F.col("asked"), keys)
    first = F.first("ord").over(Window.partitionBy(*keys, "segment").orderBy("y1", "x1", "ord"))
    moved = F.col("above") | ((F.col("part") == 2) & (F.col("segment") > 0))
    number = F.when(F.col("above"), F.col("segment") + 1).otherwise(F.col("qnum") + F.col("segment"))
    rows = rows.withColumns({"anchor_ord": F.when(moved, first).otherwise(F.col("anchor_ord")), "qnum": number.cast("int")})
    return rows.select(*blocks.columns, "anchor_ord", "qnum")


def gap_segments(blocks: DataFrame, segments: int | Column, keys: list[str]) -> DataFrame:
    """Adds segment (0-based): the blocks of each key in order of y1, cut at the segments - 1 widest vertical gaps, the
    upper of equal ones first; a key of fewer blocks than segments stays whole. segments may be a column, one value a key.
    """
    segments = F.lit(segments) if isinstance(segments, int) else segments
    order = Window.partitionBy(*keys).orderBy("y1", "x1", "ord")
    gap = F.lead("y1").over(order) - F.col("y2")
    rows = blocks.withColumns({"gap": gap, "pos": F.row_number().over(order), "members": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gap").desc_nulls_last(), "pos"))
    rows = rows.withColumn("cut", F.when((rank <= segments - 1) & F.col("gap").isNotNull() & (F.col("members") >= segments), 1).otherwise(0))
    return rows.withColumn("segment", F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("gap", "pos", "members", "cut")


def tail_filtered(blocks: DataFrame, keys: list[str], slack: int = 200, horizon: int = 3500, anchor_ord: str | None = None) -> DataFrame:
    """Blocks of a group but short or numeric ones that begin more than `slack` under the 60th percentile of the bottoms.

    The group's anchor (the block whose ord is in column anchor_ord, or else the first) stays and has no part in the percentile.
    """
    order = Window.partitionBy(*keys).orderBy("y1", "x1", "ord")
    whole = Window.partitionBy(*keys)
    rows = blocks.withColumn("pos", F.when(F.col("ord") == F.col(anchor_ord), 1).otherwise(2) if anchor_ord else F.row_number().over(order))
    sample = F.when((F.col("pos") > 1) & (F.col("y2") < horizon), F.col("y2"))
    rows = rows.withColumn("limit_y", F.round(F.percentile(sample, F.lit(0.6)).over(whole), 6) + slack)
    n, digits = F.length("txt"), F.length(F.regexp_replace("txt", "[^0-9]", ""))
    scrap = (n < 10) | ((n < 15) & (digits / F.greatest(F.lit(1), F.length(F.regexp_replace("txt", " ", ""))) > 0.5))
    keep = (F.col("pos") == 1) | F.col("limit_y").isNull() | (F.col("y1") <= F.col("limit_y")) | ~scrap
    return rows.where(keep).drop("pos", "limit_y")


def merged_lines(blocks: DataFrame, keys: list[str], reach: int = 16, kinds: tuple[str, ...] = ("text", "equation")) -> DataFrame:
    """(keys, n_lines, merged): a line is all blocks within `reach` of its first block's top, joined by spaces.

    The fold runs over a page's few blocks in one aggregate; what precedes a block decides its line, so no window can.
    """
    rows = blocks.where(_in_lines(kinds)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "ord", "txt"))).alias("all"))
    folded = rows.select(*keys, _lines(reach).alias("fold"))
    return folded.select(*keys, F.col("fold.n").cast("long").alias("n_lines"), clean_merged(F.col("fold.out")).alias("merged"))


def _in_lines(kinds: tuple[str, ...] = ("text", "equation")) -> Column:
    return F.col("kind").isin(*kinds) & (F.col("txt") != "")


def _lines(reach: int = 16) -> Column:
    """struct(top, n, out) of the sorted blocks in column `all`."""

    def step(acc: Column, b: Column) -> Column:
        same = F.abs(b["y1"] - acc["top"]) <= reach
        return F.when(acc["n"] == 0, F.struct(b["y1"].alias("top"), F.lit(1).alias("n"), b["txt"].alias("out"))).when(
            same, F.struct(acc["top"].alias("top"), acc["n"].alias("n"), F.concat(acc["out"], F.lit(" "), b["txt"]).alias("out"))
        ).otherwise(F.struct(b["y1"].alias("top"), (acc["n"] + 1).alias("n"), F.concat(acc["out"], F.lit("\n"), b["txt"]).alias("out")))

    start = F.struct(F.lit(0).alias("top"), F.lit(0).alias("n"), F.lit("").alias("out"))
    return F.aggregate("all", start, step)


def clean_merged(text: Column, keep_points: bool = True) -> Column:
    """Without save marks, trailing page numbers and blank lines; a score label keeps its points unless told otherwise."""
    t = F.regexp_replace(text, r"(?i)={10,}\s*save results:\s*={10,}", "")
    t = F.regexp_replace(t, r"\s+(\[\d{1,3}점\])\s*(\s*\d{1,5}){1,5}\s*$", " $1" if keep_points else " [4점]")
    t = F.regexp_replace(t, r"(?<![①-⑳])(\s*\n\s*|\s+)(\d{1,5}){1,5}\s*$", "")
    return F.array_join(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), "\n")


def best_groups(groups: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Of a page's groups (page, col, qnum, merged, area) with one number, the longest text, then the largest area, then
    the left one, then the first by the columns of ties.
    """
    order = Window.partitionBy("page", "qnum").orderBy(F.desc(F.length("merged")), F.desc("area"), "col", *ties)
    return groups.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def suppressed(boxes: DataFrame, most: int = 6, share: float = 0.5) -> DataFrame:
    """Greedy choice of at most `most` boxes a page, largest first, none covering half of the smaller of two; numbered top to bottom."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    item = F.struct((-area).alias("less"), "y1", "x1", "x2", "y2", "ord")
    rows = boxes.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def clash(a: Column, b: Column) -> Column:
        w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
        h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        return (w > 0) & (h > 0) & (w * h > share * F.least(-a["less"], -b["less"]))

    def step(kept: Column, b: Column) -> Column:
        return F.when((F.size(kept) >= most) | F.exists(kept, lambda a: clash(a, b)), kept).otherwise(F.concat(kept, F.array(b)))

    kept = rows.select("page", F.explode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("b")).select("page", "b.ord", "b.x1", "b.y1", "b.x2", "b.y2")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("page").orderBy("y1", "x1", "ord")).cast("long"))


def contour_candidates(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Those of boxes (x, y, w, h, mean, white, dark, border) that look like a dark number box: by size and place, by the
    mean of its grey levels, the shares of white and dark ones, and the mean of its border.
    """
    area = F.col("w") * F.col("h")
    sized = area.between(150, 20000) & F.col("w").between(20, 90) & F.col("h").between(18, 80)
    placed = (F.col("y") <= int(0.40 * height)) & ((F.col("x") < int(0.42 * width)) | (F.col("x") > int(0.48 * width)))
    return boxes.where(sized & placed & (F.col("mean") <= 130) & F.col("white").between(0.005, 0.40) & (F.col("dark") >= 0.55) & (F.col("border") <= 90))


def with_contours(blocks: DataFrame, contours: DataFrame, share: float = 0.25) -> DataFrame:
    """blocks and, as headings, the numbers of contours (page, ord, num, x1, y1, x2, y2) that no block covers."""
    new = uncovered(contours, blocks, share).select("page", "ord", F.lit("sub_title").alias("kind"), *BOX, F.col("num").cast("string").alias("txt"))
    return blocks.select(*new.columns).unionByName(new)


def problems(blocks: DataFrame, width: int, height: int, ratio: float = 0.02, contours: DataFrame | None = None) -> DataFrame:
    """Whole pages to problems: (page, qnum, merged, bx1, by1, bx2, by2, n_blocks), the chain of the operators above.

    With contours (page, ord, num, x1, y1, x2, y2) in SAT mode: their numbers join the blocks, a page without a top cut is not cut, and boxes
    may reach above the cut; else they begin there at the highest.
    """
    # A page's blocks are brought together once; every later step is within a page and needs no other shuffle.
    blocks = dedup_grid(blocks.repartition("page"))
    if contours is not None:
        blocks = with_contours(blocks, contours)
    own = grouped(columns(without_margins(blocks, height, sat=contours is not None), width))
    own = tail_filtered(own, ["page", "col", "anchor_ord", "qnum"], anchor_ord="anchor_ord")
    x1, x2, fits = G.clip_to_column(F.col("x1"), F.col("x2"), F.col("col"), F.lit(0.5 * width), F.lit(width))
    own = own.withColumns({"cx1": x1, "cx2": x2}).where(fits)
    own = own.drop("x1", "x2").withColumnsRenamed({"cx1": "x1", "cx2": "x2"})
    keys = ["page", "col", "anchor_ord", "qnum"]
    said = F.array_sort(F.collect_list(F.when(_in_lines(), F.struct("y1", "x1", "ord", "txt"))))
    bounds = own.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n_blocks"), F.max("y_cut").alias("y_cut"), said.alias("all"))
    groups = bounds.withColumn("merged", F.coalesce(clean_merged(_lines()["out"]), F.lit(""))).drop("all")
    groups = best_groups(groups.withColumn("area", F.greatest(F.lit(1), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))), ("anchor_ord",))
    wide = G.expand(*(F.col(c) for c in BOX), F.lit(width), F.lit(height), ratio)
    groups = groups.select("page", "qnum", "col", "merged", "n_blocks", "y_cut", *(b.alias("b" + c) for b, c in zip(wide, BOX)))
    a, b = G.enforce_column(F.col("bx1"), F.col("bx2"), F.col("col"), F.lit(0.5 * width), F.lit(width))
    if contours is None:
        groups = groups.withColumn("by1", F.greatest("by1", "y_cut"))
    return groups.select("page", F.col("qnum").cast("long").alias("qnum"), "merged", a.alias("bx1"), "by1", b.alias("bx2"), "by2", "n_blocks")
