"""Clauses over detected objects: counts, colours and relative positions.  Detection itself is external; its boxes are columns.

Objects are structs (class, box, color) in falling order of confidence, boxes [x1, y1, x2, y2].
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OBJECTS = "array<struct<class:string,box:array<double>,color:string>>"
CLAUSES = "array<struct<class:string,count:int,color:string,relation:string,other:int>>"


def relations(box: Column, other: Column, nearness: float = 0.1, least: float = 1e-3) -> Column:
    """Names of how ``box`` lies to ``other``; none where their centres are close for their sizes."""
    far = []
    for low, high in ((0, 2), (1, 3)):
        offset = (box[low] + box[high]) / 2 - (other[low] + other[high]) / 2
        room = nearness * (F.abs(box[high] - box[low]) + F.abs(other[high] - other[low]))
        far.append((offset, F.greatest(F.lit(0.0), F.abs(offset) - room) * F.signum(offset)))
    (dx, x), (dy, y) = far
    length = F.sqrt(dx * dx + dy * dy)
    named = [F.when(x / length < -0.5, "left of"), F.when(x / length > 0.5, "right of"), F.when(y / length < -0.5, "above"), F.when(y / length > 0.5, "below")]
    close = (F.abs(x) < least) & (F.abs(y) < least)
    return F.when(close, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*named)))


def clauses_met(objects: Column, include: Column, exclude: Column | None = None, nearness: float = 0.1) -> Column:
    """Whether all ``include`` clauses hold and no ``exclude`` clause does; false without objects at all (null).

    A clause asks for at least ``count`` objects of a class, of which it takes the first ``count``; for as many of a
    colour; and for each of them to lie in a relation to each object of the clause numbered ``other`` (from 0), which must
    itself have been met.  An exclude clause holds if there are ``count`` objects of its class.
    """
    of = lambda c: F.filter(objects, lambda o: o["class"] == c["class"])
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<array<array<double>>>").alias("met"))

    def step(s: Column, c: Column) -> Column:
        found = F.slice(of(c), F.lit(1), c["count"])
        group = F.get(s["met"], c["other"])
        placed = F.forall(found, lambda o: F.forall(group, lambda b: F.array_contains(relations(o["box"], b, nearness), c["relation"])))
        coloured = F.size(F.filter(found, lambda o: o["color"] == c["color"])) >= c["count"]
        good = (F.size(found) >= c["count"]) & (c["color"].isNull() | F.coalesce(coloured, F.lit(False))) & (c["relation"].isNull() | (group.isNotNull() & F.coalesce(placed, F.lit(False))))
        boxes = F.when(good, F.transform(found, lambda o: o["box"]))
        return F.struct((s["ok"] & good).alias("ok"), F.concat(s["met"], F.array(boxes)).alias("met"))

    met = F.aggregate(include, start, step)["ok"]
    none = F.lit(True) if exclude is None else ~F.exists(exclude, lambda c: F.size(of(c)) >= c["count"])
    return objects.isNotNull() & F.coalesce(met, F.lit(True)) & F.coalesce(none, F.lit(True))
