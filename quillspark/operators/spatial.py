"""Places on pages: which box a text stands in, what stands next to a box, boxes that lie on one another, reading order.

Boxes meet over the cells of a grid: a point is in one cell, a box in the cells that it covers, so a join on page and
cell brings only near ones together, however much a page holds. Cells are counted from what a page's points occupy, so
a box far too large doesn't make cells where nothing is. Coordinates run upwards; a row with a null coordinate, or one
that is no finite number, is nowhere. Ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..llm.scratch import written
from . import gates
from .fingerprint import min_label

PAGE = ["doc_id", "page"]
#: Side of a cell, in points.
CELL = 80.0
# How far a loose text may be from its region, and the slack of a region that is left out.
REACH, DROP_SLACK, SLACK = 40, 4, 2
NEXT_SHARE, NEXT_LINES = 0.3, 2
EDGE, COVER_SLACK = 0.085, 2
CONTAINED, MIN_FILL, GAP_X, GAP_Y, BESIDE = 0.9, 0.7, 30, 14, 0.5
SAME_LABEL, COLLIDING = 0.5, 0.4
PARTED = 3
RULE_LOW, RULE_GAP, RULE_SHIFT = 0.4, 14, 30
FOOTNOTE = r"^\s*(?:\^(?:\d+|[*†‡])\^|[¹²³⁴⁵⁶⁷⁸⁹⁰†‡*])"
NUMBER_EDGE, PAGE_NUMBER = 0.06, r"^\s*\d{1,4}\s*$"
MIDDLE = 0.08


def _cell(v: Column) -> Column:
    return F.floor(v / CELL).cast("long")


def _finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 1e15)
    return out


def points(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """``rows`` with ``px``, ``py`` and the cell (``cx``, ``cy``) of the point; rows without a place are left out."""
    return rows.withColumns({"px": x, "py": y}).where(_finite(F.col("px"), F.col("py"))).withColumns({"cx": _cell(F.col("px")), "cy": _cell(F.col("py"))})


def in_cells(boxes: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, placed: DataFrame) -> DataFrame:
    """``boxes`` once for each cell that they cover out of those between the outermost points of their page in ``placed``."""
    used = placed.groupBy(*PAGE).agg(*[f(c).alias(f"{n}_{c}") for c in ("cx", "cy") for n, f in (("least", F.min), ("most", F.max))])
    both = boxes.where(_finite(x1, y1, x2, y2) & (x1 <= x2) & (y1 <= y2)).join(used.hint("merge"), PAGE)
    span = lambda low, high, c: F.when(F.least(high, F.col(f"most_{c}")) >= F.greatest(low, F.col(f"least_{c}")), F.sequence(F.greatest(low, F.col(f"least_{c}")), F.least(high, F.col(f"most_{c}"))))
    across, up = span(_cell(x1), _cell(x2), "cx"), span(_cell(y1), _cell(y2), "cy")
    cells = F.flatten(F.transform(across, lambda cx: F.transform(up, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    wide = both.withColumn("cell", F.explode(cells))
    return wide.select(*boxes.columns, F.col("cell.cx").alias("cx"), F.col("cell.cy").alias("cy"))


def near_boxes(placed: DataFrame, boxes: DataFrame, slack: float) -> DataFrame:
    """Each row of ``placed`` (of ``points``) with each of ``boxes`` (doc_id, page, ``box`` with x1, y1, x2, y2 and more) that is within ``slack`` of it along both axes."""
    b = F.col("box")
    spread = in_cells(boxes, b["x1"] - slack, b["y1"] - slack, b["x2"] + slack, b["y2"] + slack, placed)
    met = placed.hint("merge").join(spread.hint("merge"), [*PAGE, "cx", "cy"])
    return met.where(_inside(slack))


def _inside(slack: float) -> Column:
    b = F.col("box")
    return (F.col("px") >= b["x1"] - slack) & (F.col("px") <= b["x2"] + slack) & (F.col("py") >= b["y1"] - slack) & (F.col("py") <= b["y2"] + slack)


def assigned(items: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, item, region, how): the region in which each item's middle lies, the smallest if there are several.

    ``items``: doc_id, page, item, x, y, width, size; ``regions``: doc_id, page, region, x1, y1, x2, y2, dropped. An
    item in no region (``how``: inside) is left out if a dropped region holds it (dropped), else goes to the
    nearest region less than ``REACH`` away (near), else to none (far). Items without a place are nowhere, and far.
    """
    middle = points(items, F.col("x") + F.col("width") / 2, F.col("y") + F.col("size") / 2)
    area = F.greatest(F.lit(0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    boxes = regions.select(*PAGE, F.struct(area.alias("area"), "region", "x1", "y1", "x2", "y2", "dropped").alias("box"))
    b = F.col("box")
    dx, dy = (F.greatest(b[f"{c}1"] - F.col(f"p{c}"), F.lit(0), F.col(f"p{c}") - b[f"{c}2"]) for c in "xy")
    away = dx * dx + dy * dy
    told = near_boxes(middle, boxes, REACH).groupBy(*PAGE, "item").agg(
        F.min(F.when(~b["dropped"] & _inside(SLACK), F.struct(b["area"].alias("by"), b["region"].alias("region"))))["region"].alias("inside"),
        F.max(b["dropped"] & _inside(DROP_SLACK)).alias("out"),
        F.min(F.when(~b["dropped"] & (away < REACH * REACH), F.struct(away.alias("by"), b["region"].alias("region"))))["region"].alias("near"),
    )
    how = F.when(F.col("inside").isNotNull(), "inside").when(F.col("out"), "dropped").when(F.col("near").isNotNull(), "near").otherwise("far")
    both = items.select(*PAGE, "item").join(told.hint("merge"), [*PAGE, "item"], "left").withColumn("how", how)
    return both.select(*PAGE, "item", F.when(F.col("how") == "inside", F.col("inside")).when(F.col("how") == "near", F.col("near")).alias("region"), "how")


def uncovered(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items (doc_id, page, item, x, y, width, size, page_height, ...) that no box (doc_id, page, x, y, width, height) covers, with ``edge``: at the page's upper or lower edge."""
    low = points(items, F.col("x") + F.col("width") / 2, F.col("y") + F.col("size") * 0.35)
    covers = boxes.select(*PAGE, F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2")).alias("box"))
    held = near_boxes(low.select(*PAGE, "item", "px", "py", "cx", "cy"), covers, COVER_SLACK).select(*PAGE, "item").distinct()
    edge = (F.col("y") >= F.col("page_height") * (1 - EDGE)) | (F.col("y") <= F.col("page_height") * EDGE)
    return items.join(held.hint("merge"), [*PAGE, "item"], "left_anti").withColumn("edge", edge)


def next_texts(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, page, box, above, below): of each box the text right above it and right below, as structs (y, size), null if there is none.

    ``boxes``: doc_id, page, box, x, y, width, height; ``texts``: doc_id, page, text, x, y, width, height, size. A text
    counts if it overlaps three tenths of the narrower's width. Above: its lower edge in the box's upper half or higher, its
    middle over the box and its lower edge less than two lines over it; the lowest is taken. Below likewise, the highest.
    """
    box = boxes.select(*PAGE, "box", *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "width", "height")]).where(_finite(*[F.col(f"b_{c}") for c in ("x", "y", "width", "height")]))
    size = F.coalesce("size", F.lit(10))
    text = texts.select(*PAGE, "text", "x", "y", "width", "height", size.alias("size")).where(_finite(*[F.col(c) for c in ("x", "y", "width", "height", "size")]))
    top, middle, reach = F.col("y") + F.col("height"), F.col("y") + F.col("height") / 2, F.col("size") * NEXT_LINES
    # the box's upper edge lies over a text's stretch from two lines under it to its middle, or the lower edge from there to two lines over it
    edges = box.select("*", F.explode(F.array(F.struct(F.lit("above").alias("side"), (F.col("b_y") + F.col("b_height")).alias("at")), F.struct(F.lit("below").alias("side"), F.col("b_y").alias("at")))).alias("e")).withColumn("cy", _cell(F.col("e.at")))
    used = edges.groupBy(*PAGE).agg(F.min("cy").alias("least"), F.max("cy").alias("most"))
    stretch = text.withColumn("side", F.explode(F.array(F.lit("above"), F.lit("below"))))
    low, high = F.when(F.col("side") == "above", F.col("y") - reach).otherwise(middle), F.when(F.col("side") == "above", middle).otherwise(top + reach)
    within = stretch.join(used.hint("merge"), PAGE).withColumns({"from": F.greatest(_cell(low), F.col("least")), "to": F.least(_cell(high), F.col("most"))}).where("`from` <= `to`")
    banded = within.withColumn("cy", F.explode(F.sequence("from", "to"))).drop("from", "to", "least", "most")
    met = edges.withColumn("side", F.col("e.side")).hint("merge").join(banded.hint("merge"), [*PAGE, "cy", "side"])
    shared = F.least(F.col("b_x") + F.col("b_width"), F.col("x") + F.col("width")) - F.greatest("b_x", "x")
    half, at = F.col("b_y") + F.col("b_height") / 2, F.col("e.at")
    above = (F.col("side") == "above") & (F.col("y") >= half) & (middle > at) & (F.col("y") < at + reach)
    below = (F.col("side") == "below") & (top <= half) & (middle < at) & (top > at - reach) & ~((F.col("y") >= half) & (middle > F.col("b_y") + F.col("b_height")) & (F.col("y") < F.col("b_y") + F.col("b_height") + reach))
    good = met.where((shared >= F.least("b_width", "width") * NEXT_SHARE) & (above | below))
    found = good.groupBy(*PAGE, "box").agg(
        F.min(F.when(above, F.struct(F.col("y").alias("edge"), F.col("text"), F.col("size")))).alias("a"), F.min(F.when(below, F.struct((-top).alias("edge"), F.col("text"), F.col("size")))).alias("b")
    )
    told = found.select(*PAGE, "box", F.when(F.col("a").isNotNull(), F.struct(F.col("a.edge").alias("y"), F.col("a.size").alias("size"))).alias("above"), F.when(F.col("b").isNotNull(), F.struct((-F.col("b.edge")).alias("y"), F.col("b.size").alias("size"))).alias("below"))
    return boxes.select(*PAGE, "box").join(told.hint("merge"), [*PAGE, "box"], "left")


def _boxes(rows: DataFrame, item: str) -> DataFrame:
    """(doc_id, page, box): rows with x, y, width, height as boxes with ``id`` and ``area``."""
    return rows.select(*PAGE, F.struct(F.col(item).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"), (F.col("width") * F.col("height")).alias("area")).alias("box"))


def _shared(a: Column, b: Column, axis: str) -> Column:
    return F.greatest(F.lit(0), F.least(a[f"{axis}2"], b[f"{axis}2"]) - F.greatest(a[f"{axis}1"], b[f"{axis}1"]))


def meeting(boxes: DataFrame, more: DataFrame | None = None, slack_x: float = 0, slack_y: float = 0) -> DataFrame:
    """(doc_id, page, a, b): pairs of boxes of a page that touch or come within the slacks, each pair once, a's id the smaller; with ``more`` each of ``boxes`` with each of those.

    Two boxes meet in the cell of the lower left corner of what they share, and only there.
    """
    b = F.col("box")
    every = boxes.unionByName(more) if more is not None else boxes
    corners = every.where(_finite(b["x1"], b["y1"])).select(*PAGE, _cell(b["x1"] - slack_x / 2).alias("cx"), _cell(b["y1"] - slack_y / 2).alias("cy"))
    spread = lambda rows: in_cells(rows, b["x1"] - slack_x / 2, b["y1"] - slack_y / 2, b["x2"] + slack_x / 2, b["y2"] + slack_y / 2, corners)
    left, right = spread(boxes).withColumnRenamed("box", "a"), spread(boxes if more is None else more).withColumnRenamed("box", "b")
    met = left.hint("merge").join(right.hint("merge"), [*PAGE, "cx", "cy"])
    a, b = F.col("a"), F.col("b")
    touch = (F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]) <= slack_x) & (F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]) <= slack_y)
    once = (F.col("cx") == _cell(F.greatest(a["x1"], b["x1"]) - slack_x / 2)) & (F.col("cy") == _cell(F.greatest(a["y1"], b["y1"]) - slack_y / 2))
    return met.where(touch & once & ((a["id"] < b["id"]) if more is None else F.lit(True))).select(*PAGE, "a", "b")


def contained(figures: DataFrame) -> DataFrame:
    """(doc_id, page, item): figures (doc_id, page, item, x, y, width, height) of which nine tenths lie in a larger one of their page."""
    a, b = F.col("a"), F.col("b")
    shared = _shared(a, b, "x") * _shared(a, b, "y")
    within = lambda one, other: F.when((one["area"] > 0) & (other["area"] > one["area"]) & (shared / one["area"] >= CONTAINED), one["id"])
    held = meeting(_boxes(figures, "item")).select(*PAGE, F.array_compact(F.array(within(a, b), within(b, a))).alias("items"))
    return held.select(*PAGE, F.explode("items").alias("item")).distinct()


def figure_clusters(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block_order, cluster, x1, y1, x2, y2): figures that belong together share the order of their first and the box around them.

    ``blocks``: doc_id, page, block_order, kind, x, y, width, height, in reading order. Together are figures of a page with nothing
    else between them that stand side by side or one under another, as far as they fill seven tenths of the box around
    them. Margins count for nothing; a figure inside another one is left out.
    """
    # written, as each box is read for corners and cells on both sides, and every reading would make the blocks anew
    blocks = written(blocks.select(*PAGE, "block_order", "kind", "x", "y", "width", "height"), "boxes")
    figures = blocks.where("kind = 'figure'").withColumn("item", F.col("block_order"))
    flow = blocks.where("kind <> 'margin'").join(contained(figures).select("doc_id", "page", F.col("item").alias("block_order"), F.lit("figure").alias("kind")).hint("merge"), [*PAGE, "block_order", "kind"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy("block_order")
    goes_on = (F.col("kind") == "figure") & (F.lag("kind").over(order) == "figure") & (F.lag("page").over(order) == F.col("page"))
    runs = flow.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order)).where("kind = 'figure'")
    runs = written(runs, "runs")
    named = runs.select(*PAGE, F.struct(F.struct("doc_id", "block_order", "run").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"), (F.col("width") * F.col("height")).alias("area")).alias("box"))
    a, b = F.col("a"), F.col("b")
    apart = lambda c: F.greatest(a[f"{c}1"], b[f"{c}1"]) - F.least(a[f"{c}2"], b[f"{c}2"])
    beside = lambda c: _shared(a, b, c) / F.greatest(F.lit(1), F.least(a[f"{c}2"] - a[f"{c}1"], b[f"{c}2"] - b[f"{c}1"])) >= BESIDE
    linked = ((apart("x") <= GAP_X) & beside("y")) | ((apart("y") <= GAP_Y) & beside("x"))
    edges = meeting(named, slack_x=GAP_X, slack_y=GAP_Y).where((a["id"]["run"] == b["id"]["run"]) & linked).select(a["id"].alias("a"), b["id"].alias("b"))
    ids = runs.select(F.struct("doc_id", "block_order", "run").alias("id"))
    labels = min_label(edges, ids, "id").select("id.doc_id", "id.block_order", F.col("cluster.block_order").alias("cluster"))
    together = Window.partitionBy("doc_id", "cluster")
    x1, y1, x2, y2 = F.min("x").over(together), F.min("y").over(together), F.max(F.col("x") + F.col("width")).over(together), F.max(F.col("y") + F.col("height")).over(together)
    both = runs.join(labels.hint("merge"), ["doc_id", "block_order"]).withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "filled": F.sum(F.col("width") * F.col("height")).over(together)})
    loose = F.col("filled") < (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * MIN_FILL
    own = {"cluster": F.col("block_order"), "x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height")}
    return both.select(*PAGE, "block_order", *[F.when(loose, one).otherwise(F.col(c)).alias(c) for c, one in own.items()])


def colliding(items: DataFrame) -> DataFrame:
    """(doc_id, page, item): texts (doc_id, page, item, str, x, y, width, size) that lie over another text of their page by more than four tenths of the smaller; of three signs or more, and different."""
    good = items.where((F.char_length(F.trim("str")) >= 3) & (F.col("width") > 0)).withColumn("height", F.col("size"))
    named = good.select(*PAGE, F.struct(F.struct("item", F.trim("str").alias("s")).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("size")).alias("y2"), (F.col("width") * F.col("size")).alias("area")).alias("box"))
    a, b = F.col("a"), F.col("b")
    over = meeting(named).where((a["id"]["s"] != b["id"]["s"]) & (_shared(a, b, "x") * _shared(a, b, "y") > F.least(a["area"], b["area"]) * COLLIDING))
    return over.select(*PAGE, F.explode(F.array(a["id"]["item"], b["id"]["item"])).alias("item")).distinct()


def suppressed(found: DataFrame, most: float = SAME_LABEL) -> DataFrame:
    """Boxes (doc_id, page, label, score, item, x1, y1, x2, y2) that stay: best first, one that shares more than half with a kept one of its label goes.

    A page's boxes of a label are few (a detector gives some hundred), and are folded in order; equal scores in order of item.
    """
    box = F.struct((-F.col("score")).alias("by"), "item", "score", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    listed = found.where(_finite(*[F.col(c) for c in ("score", "x1", "y1", "x2", "y2")])).groupBy(*PAGE, "label").agg(F.array_sort(F.collect_list(box)).alias("all"))

    def share(a: Column, b: Column) -> Column:
        both = _shared(a, b, "x") * _shared(a, b, "y")
        size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
        return both / (size(a) + size(b) - both + 1e-6)

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, r: F.when(F.exists(kept, lambda k: share(k, r) > most), kept).otherwise(F.concat(kept, F.array(r))))
    return listed.select(*PAGE, "label", F.explode(kept).alias("r")).select(*PAGE, "label", "r.item", "r.score", "r.x1", "r.y1", "r.x2", "r.y2")


def split_at_gaps(items: DataFrame) -> DataFrame:
    """Items (doc_id, page, region, item, y, size) with ``part``: where baselines lie more than three font sizes apart, downwards, a new part begins.

    The font size is the region's upper median over sizes above 1, or 10.
    """
    region = Window.partitionBy(*PAGE, "region")
    counted = F.col("size") > 1
    order = region.orderBy(F.desc("y"), "item")
    turn, n = F.row_number().over(Window.partitionBy(*PAGE, "region", counted).orderBy("size", "item")), F.sum(F.when(counted, 1)).over(region)
    ranked = items.withColumns({"turn": turn, "n": n})
    middle = F.max(F.when(counted & (F.col("turn") == F.floor(F.col("n") / 2) + 1), F.col("size").cast("double"))).over(region)
    with_size = ranked.withColumn("usual", F.coalesce(middle, F.lit(10.0)))
    fresh = F.when(F.lag("y").over(order) - F.col("y") > PARTED * F.col("usual"), 1).otherwise(0)
    return with_size.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order)).drop("usual", "fresh", "turn", "n")


def footnote_rules(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page, block, rule): rules (doc_id, page, rule, x, y, width, page_height) on the lower page with the footnote right below: the nearest within 14 points, left edges 30 apart at most. A block keeps the first rule that takes it."""
    notes = blocks.where(F.col("text").rlike(FOOTNOTE)).select(*PAGE, "block", *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "width", "height")]).where(_finite(*[F.col(f"b_{c}") for c in ("x", "y", "width", "height")]))
    top = F.col("b_y") + F.col("b_height")
    low = rules.where((F.col("y") <= F.col("page_height") * RULE_LOW) & _finite(F.col("x"), F.col("y"), F.col("width"))).withColumn("cy", F.explode(F.array(_cell(F.col("y")), _cell(F.col("y")) - 1)))
    gap = F.col("y") - top
    near = (gap >= 0) & (gap <= RULE_GAP) & (F.abs(F.col("b_x") - F.col("x")) <= RULE_SHIFT) & (F.col("x") + F.col("width") <= F.col("b_x") + F.col("b_width") + RULE_SHIFT)
    met = low.hint("merge").join(notes.withColumn("cy", _cell(top)).hint("merge"), [*PAGE, "cy"]).where(near)
    nearest = met.groupBy(*PAGE, "rule").agg(F.min(F.struct(gap.alias("gap"), "block"))["block"].alias("block"))
    return nearest.groupBy(*PAGE, "block").agg(F.min("rule").alias("rule"))


def page_number(text: Column, y: Column, page_height: Column) -> Column:
    """Is it a number at the page's upper or lower edge?"""
    return text.rlike(PAGE_NUMBER) & ((y < page_height * NUMBER_EDGE) | (y > page_height * (1 - NUMBER_EDGE)))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, item, x, y, width, page_width) with ``band``, ``column`` (full, left, right) and ``place`` in the page.

    A line across the page's middle is a band of its own; the lines between two of them are a band, its left column
    before its right one. Lines of one height stay in order of item.
    """
    half, slack = F.col("page_width") / 2, F.col("page_width") * MIDDLE
    full = (F.col("x") < half - slack) & (F.col("x") + F.col("width") > half + slack)
    column = F.when(full, "full").when(F.col("x") + F.col("width") / 2 < half, "left").otherwise("right")
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "item")
    cut = lines.withColumn("column", column).withColumn("above", F.sum(F.when(F.col("column") == "full", 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct("above", F.col("column") != "full", F.col("column") == "right", -F.col("y"), F.col("item"))
    band = F.col("above") * 2 + F.when(F.col("column") == "full", 0).otherwise(1)
    placed = cut.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(key)))
    return placed.withColumn("band", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy(band))).drop("above")


def parsed_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page, paragraph, kind, text, section, x0, y0, x1, y1, n): the lines of pages as paragraphs and headings, in reading order.

    ``lines``: doc_id, page, item, text, x, y, width, height, size, heading, page_width. Bands and columns give the order
    (``reading_order``); gaps and headings cut it into paragraphs; a section's name is that of the heading before.
    """
    placed = reading_order(lines).withColumn("block_order", F.col("place"))
    cut = gates.paragraphs(placed, PAGE)
    box = {"x0": F.min("x"), "y0": F.min("y"), "x1": F.max(F.col("x") + F.col("width")), "y1": F.max(F.col("y") + F.col("height"))}
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "text"))), lambda t: t["text"]), " ")  # the lines of a paragraph
    made = cut.groupBy(*PAGE, "paragraph").agg(F.max("heading").alias("heading"), text.alias("text"), *[c.alias(k) for k, c in box.items()], F.count(F.lit(1)).alias("n"))
    before = F.last(F.when(F.col("heading"), F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page", "paragraph"))
    return made.select(*PAGE, "paragraph", F.when(F.col("heading"), "heading").otherwise("para").alias("kind"), "text", before.alias("section"), *box, "n")
