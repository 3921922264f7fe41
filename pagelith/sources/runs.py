"""Positioned text: affine placement of runs, glyph boxes, boxes of text ranges, image rectangles.

Runs: doc_id, page, item_no, str, matrix array<double>(6), width, height. Pages are
counted from 0 from here on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelith.operators.grouped import grouped


def product(a: Column, b: Column) -> Column:
    """Of two affine matrices (a b c d e f)."""
    g = lambda m, i: F.get(m, F.lit(i))
    cell = lambda i, j: g(a, i % 2) * g(b, j) + g(a, 2 + i % 2) * g(b, j + 1)
    return F.array(cell(0, 0), cell(1, 0), cell(0, 2), cell(1, 2), cell(0, 4) + g(a, 4), cell(1, 4) + g(a, 5))


def placed(runs: DataFrame, viewport: Column) -> DataFrame:
    """x, y, w, h of each run at the page's scale, y at the top; rotated runs are marked."""
    g = lambda c, i: F.get(F.col(c), F.lit(i))
    r = runs.withColumn("view", viewport).withColumn("m", product(F.col("view"), F.col("matrix")))
    h = F.greatest(F.hypot(g("m", 2), g("m", 3)), F.coalesce("height", F.lit(0.0)))
    scale = F.hypot(g("view", 0), g("view", 1))
    w = F.col("width") * F.when(scale == 0, 1.0).otherwise(scale)
    rotated = (F.hypot(g("m", 0), g("m", 1)) > 0) & ((F.abs(g("m", 1)) > 1e-8) | (g("m", 0) < 0))
    return r.select("doc_id", "page", "item_no", "str", g("m", 4).alias("x"), (g("m", 5) - h).alias("y"), w.alias("w"), h.alias("h"), rotated.alias("rotated"))


def stretches(items: DataFrame, separator: int = 1) -> DataFrame:
    """One row per run with text: its place in the line's text, runs joined by a separator, its n characters and their width."""
    w = Window.partitionBy("doc_id", "page", "line_no").orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("str") + separator).over(w), F.lit(0))
    i = items.withColumn("source", offset).where(F.length("str") > 0).withColumn("n", F.length("str"))
    return i.select("doc_id", "page", "line_no", "source", "str", "n", "x", "y", (F.col("w") / F.col("n")).alias("w"), "h")


def glyphs(items: DataFrame, separator: int = 1) -> DataFrame:
    """One row per character: equal parts of its run, and its place in the line's text, runs joined by a separator."""
    c = stretches(items, separator).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return c.select(
        "doc_id", "page", "line_no", (F.col("source") + F.col("k")).alias("source"), F.substr("str", F.col("k") + 1, F.lit(1)).alias("ch"),
        (F.col("x") + F.col("k") * F.col("w")).alias("x"), "y", "w", "h",
    )


BOXES = "doc_id long, range_id long, x double, y double, w double, h double"


def line_boxes(rows: list[dict], dy: float, gap: float) -> list[list[float]]:
    """Boxes of characters a to z (without) of each stretch, as if taken one by one; the rest of a stretch follows its first at once."""
    out: list[list[float]] = []
    for c in rows:
        x0, y, w, h, k, z = c["x"], c["y"], c["w"], c["h"], c["a"], c["z"]
        while k < z:
            x, b = x0 + k * w, out[-1] if out else None
            if b and abs(y - b[1]) <= dy and x <= b[0] + b[2] + gap and b[0] <= x + w + gap:
                left, right = min(b[0], x), max(b[0] + b[2], x + w)
                b[0], b[2] = left, right - left
            else:
                b = [x, y, w, h]
                out.append(b)
            k += 1
            least = 1e-9 * (abs(x0) + z * w + abs(b[0]) + abs(b[2]))  # far above rounding
            if not (w > least and gap > least and dy >= 0):
                continue
            last = x0 + (z - 1) * w + w
            while k < z:
                right = b[0] + b[2]
                if x0 + k * w + w > right or right - b[0] == b[2]:  # wider with each from here on, or not until one ends beyond
                    b[2], k = last - b[0] if last > right else b[2], z
                else:
                    b[2], k = right - b[0], k + 1
    return out


def range_boxes(chars: DataFrame, ranges: DataFrame, dy: float = 2.0, gap: float = 4.0) -> DataFrame:
    """Line boxes of ranges(doc_id, range_id, first, last) over chars(doc_id, source, x, y, w, h): one per stretch without a jump.

    With a column n, a row stands for n characters of width w side by side, the first at
    source and x; such rows travel whole.
    """
    n = F.col("n") if "n" in chars.columns else F.lit(1)
    c = chars.select("doc_id", "source", n.alias("n"), "x", "y", "w", "h")
    picked = c.join(ranges.select("doc_id", "range_id", "first", "last"), "doc_id").where("source < last AND source + n > first").select(
        "doc_id", "range_id", "source", "x", "y", "w", "h", F.greatest(F.col("first") - F.col("source"), F.lit(0)).alias("a"), F.least(F.col("last") - F.col("source"), F.col("n")).alias("z"),
    )

    def run(rows: list[dict]) -> list[tuple]:
        return [(rows[0]["doc_id"], rows[0]["range_id"], *b) for b in line_boxes(rows, dy, gap)]

    return grouped(picked, ["doc_id", "range_id"], ["source"], run, BOXES)


IMAGES = "doc_id long, page long, x double, y double, w double, h double"


def image_regions(operations: DataFrame, viewport: tuple[float, ...]) -> DataFrame:
    """Rectangles of painted images: operations(doc_id, page, seq, op, args) are save, restore, transform and paint."""

    def times(a, b):
        return tuple(a[i % 2] * b[j] + a[2 + i % 2] * b[j + 1] + (a[4 + i % 2] if j == 4 else 0) for j in (0, 2, 4) for i in (0, 1))

    def run(rows: list[dict]) -> list[tuple]:
        unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        now, stack, out = unit, [], []
        for r in rows:
            if r["op"] == "save":
                stack.append(now)
            elif r["op"] == "restore":
                now = stack.pop() if stack else unit
            elif r["op"] == "transform" and r["args"] and len(r["args"]) == 6:
                now = times(now, r["args"])
            elif r["op"] == "paint":
                a, b, c, d, e, f = times(viewport, now)
                xs, ys = (e, a + e, c + e, a + c + e), (f, b + f, d + f, b + d + f)
                if max(xs) - min(xs) > 0.5 and max(ys) - min(ys) > 0.5:
                    out.append((r["doc_id"], r["page"], min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)))
        return out

    return grouped(operations, ["doc_id", "page"], ["seq"], run, IMAGES)
