"""Joins by distance and time: grid cells turn them into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import geo, rings
from tidewake.session import stable


def cell(c: Column, side: float) -> Column:
    return F.floor(c / F.lit(side)).cast("int")


def _cells_within(lon: str, lat: str, metres: Column, side: float) -> tuple[Column, Column]:
    """Rows and columns of the cells that a circle can touch (a little wide, never narrow)."""
    d_lat = metres / 110_000.0
    widest = F.least(F.abs(F.col(lat)) + d_lat, F.lit(89.0))
    d_lon = metres / (110_000.0 * F.cos(F.radians(widest)))
    xs = F.sequence(cell(F.col(lon) - d_lon, side), cell(F.col(lon) + d_lon, side))
    ys = F.sequence(cell(F.col(lat) - d_lat, side), cell(F.col(lat) + d_lat, side))
    return xs, ys


def within_distance(left: DataFrame, right: DataFrame, radius: Column, on: list[str], how: str = "inner", side: float = 0.05, names: tuple[str, str, str, str] = ("lon", "lat", "r_lon", "r_lat"), out: str = "distance_m") -> DataFrame:
    """Pairs of a left point and a right point no farther apart than the right row's radius.

    Right rows are exploded over the cells that their circle touches, left rows have one
    cell, and the join is on cell and ``on``: each pair meets once, so nothing is deduplicated.
    ``how`` may be inner, left_semi or left_anti; the radius is in metres and inclusive.
    """
    l_lon, l_lat, r_lon, r_lat = names
    r = right.withColumn("_r", radius)
    xs, ys = _cells_within(r_lon, r_lat, F.col("_r"), side)
    r = r.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))
    for k in on:
        r = r.withColumnRenamed(k, f"_on_{k}")
    l = left.withColumn("_lx", cell(F.col(l_lon), side)).withColumn("_ly", cell(F.col(l_lat), side))  # noqa: E741
    d = geo.distance(l_lon, l_lat, r_lon, r_lat)
    cond = (F.col("_lx") == F.col("_cx")) & (F.col("_ly") == F.col("_cy")) & F.expr(f"{d} <= _r")
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_on_{k}"))
    joined = l.join(r, cond, how)
    if how == "inner":
        joined = joined.withColumn(out, F.expr(d)).drop("_r", "_cx", "_cy", *(f"_on_{k}" for k in on))
    return joined.drop("_lx", "_ly")


def _over_cells(boxes: DataFrame, metres: float, side: float) -> DataFrame:
    """Boxes, with ring and holes where there are, as ``_``-columns in every cell that ``metres`` around them touch."""
    pad_lat = metres / 110_000.0
    b = boxes.select(*(F.col(c).alias(f"_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat", "ring", "holes") if c in boxes.columns))
    pad_lon = F.lit(pad_lat) / F.cos(F.radians(F.least(F.greatest(F.abs("_min_lat"), F.abs("_max_lat")) + pad_lat, F.lit(89.0))))
    b = b.withColumn("_cx", F.explode(F.sequence(cell(F.col("_min_lon") - pad_lon, side), cell(F.col("_max_lon") + pad_lon, side))))
    return b.withColumn("_cy", F.explode(F.sequence(cell(F.col("_min_lat") - pad_lat, side), cell(F.col("_max_lat") + pad_lat, side))))


def told_near_boxes(points: DataFrame, boxes: DataFrame, metres: float, out: str, side: float = 0.05, names: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """``points`` with ``out``: whether any of ``boxes`` is within ``metres``, as in ``near_boxes``.

    A cell's polygons are one row, so each point is judged where it stands and needs no id.
    """
    lon, lat = (F.col(n) for n in names)
    b = _over_cells(boxes, metres, side)
    own = b.groupBy("_cx", "_cy").agg(F.collect_list(F.struct(*(c for c in b.columns if c not in ("_cx", "_cy")))).alias("_polygons"))

    def near(p: Column) -> Column:
        clamped = (F.least(F.greatest(lon, p["_min_lon"]), p["_max_lon"]), F.least(F.greatest(lat, p["_min_lat"]), p["_max_lat"]))
        close = geo.distance_columns(lon, lat, *clamped) <= metres
        if "_ring" in b.columns:
            close = close & (p["_ring"].isNull() | (rings.distance(p["_ring"], *names, p["_holes"] if "_holes" in b.columns else None) <= metres))
        return close

    met = points.join(own, (cell(lon, side) == F.col("_cx")) & (cell(lat, side) == F.col("_cy")), "left")
    return met.withColumn(out, F.coalesce(F.exists("_polygons", near), F.lit(False))).drop("_cx", "_cy", "_polygons")


def near_boxes(points: DataFrame, boxes: DataFrame, metres: float, how: str = "left_semi", side: float = 0.05, names: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """Points within ``metres`` of any box (min_lon, min_lat, max_lon, max_lat), or of none with left_anti.

    A row with a ring (and holes) stands for that polygon: its box only finds the candidates.
    """
    lon, lat = names
    b = _over_cells(boxes, metres, side)
    near = F.expr(f"{geo.distance_to_box(lon, lat, ('_min_lon', '_min_lat', '_max_lon', '_max_lat'))} <= {metres!r}")
    if "_ring" in b.columns:
        holes = F.col("_holes") if "_holes" in b.columns else None
        near = near & (F.col("_ring").isNull() | (rings.distance(F.col("_ring"), lon, lat, holes) <= metres))
    return points.join(b, (cell(F.col(lon), side) == F.col("_cx")) & (cell(F.col(lat), side) == F.col("_cy")) & near, how)


def box_cells(box: tuple[str, str, str, str], pad_m: float, side: float) -> tuple[Column, Column]:
    """Rows and columns of the cells that a box and ``pad_m`` metres around it touch (a little wide, never narrow)."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    d_lat = pad_m / 110_000.0
    d_lon = F.lit(d_lat) / F.cos(F.radians(F.least(F.greatest(F.abs(y0), F.abs(y1)) + d_lat, F.lit(89.0))))
    return F.sequence(cell(x0 - d_lon, side), cell(x1 + d_lon, side)), F.sequence(cell(y0 - d_lat, side), cell(y1 + d_lat, side))


#: Width of the buckets of time in which a key's facts are ordered, and of those in which they are looked through, in greatest ages.
_ORDERED, _LOOKED = 8, 2


def _bucket(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("long")


def _buckets_around(us: str, max_age_us: int, width: int) -> Column:
    """The buckets of time that an instant and ``max_age_us`` on both sides of it touch."""
    return F.explode(F.sequence(_bucket(F.col(us) - max_age_us, width), _bucket(F.col(us) + max_age_us, width)))


def reigns(facts: DataFrame, key: str, max_age_us: int, side: float = 2.0, instants: DataFrame | None = None) -> DataFrame:
    """Facts with the span of instants, ``_from`` to ``_to``, for which each is its key's nearest in time.

    A key's facts are dealt out in buckets of time, each with the facts up to ``max_age_us``
    outside it, and ordered there: a span ends half way to the neighbours (the earlier fact
    has the middle), at ``max_age_us`` and at its bucket's ends. So every instant has one fact
    of a key at most, and a key with very many facts is ordered in many pieces. Of facts at one
    time the one with the smallest id stands for all. ``_cells`` are the cells of ``side``
    degrees in which the key has facts in and around the bucket, ``_several`` tells whether
    there is more than one place, ``_extent`` is the box of all of them. With ``instants``
    (sensed_us) only buckets that hold one of them are made. A bucket is wide, so few facts are in two of them.
    """
    width = _ORDERED * max(1, max_age_us)
    near = facts.withColumn("_b", _buckets_around("time_us", max_age_us, width))
    if instants is not None:
        near = near.join(F.broadcast(instants.select(_bucket(F.col("sensed_us"), width).alias("_b")).distinct()), "_b", "left_semi")
    near = near.repartition(key, "_b")  # the only shuffle: facts are narrow, what is gathered from them isn't
    whole = W.partitionBy(key, "_b")
    rest = [c for c in facts.columns if c not in (key, "time_us", "id")]
    place = F.struct(cell(F.col("lon"), side).alias("x"), cell(F.col("lat"), side).alias("y"))
    # gathered once a bucket, not once a fact; the aggregate then goes by the window's order
    extent = F.struct(*(f(c).over(whole).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lon", "lat")))
    near = near.select("*", F.collect_set(place).over(whole).alias("_cells"), extent.alias("_extent"))
    alike = lambda c: F.any_value(c).alias(c)
    at = near.groupBy(key, "_b", "time_us").agg(F.min(F.struct("id", *rest)).alias("_first"), alike("_cells"), alike("_extent"))
    order = whole.orderBy("time_us")
    half = lambda other: F.shiftright(F.col("time_us") + other, 1)
    out = at.select(
        key, "time_us", "_first",
        F.greatest(half(F.lag("time_us").over(order)) + 1, F.col("time_us") - max_age_us, F.col("_b") * width).alias("_from"),
        F.least(half(F.lead("time_us").over(order)), F.col("time_us") + max_age_us, (F.col("_b") + 1) * width - 1).alias("_to"),
        "_cells", F.expr("_extent.min_lon < _extent.max_lon or _extent.min_lat < _extent.max_lat").alias("_several"), "_extent",
    )
    return out.filter("_from <= _to").select(key, "time_us", "_first.*", "_from", "_to", "_cells", "_several", "_extent")


def nearest_in_time(facts: DataFrame, instants: DataFrame, key: str, max_age_us: int, instant_key: str, within: Column | None = None, area: tuple[str, str, str, str] | None = None, pad_m: float = 0.0, side: float = 2.0, slots: int = 12, salts: int = 64) -> DataFrame:
    """Per instant and key, the fact closest in time, before or after, of those ``within`` (ties: earlier, then smaller id).

    ``facts`` has time_us, id, lon and lat; ``instants`` has ``instant_key`` and sensed_us.
    An as-of join: each key's facts are put in the order of time once, which gives each fact the
    span in which it is the nearest, and a span meets the instants inside it, so an instant
    meets one fact of a key and not all those around it. Spans and instants meet by slots of
    time (``slots`` to twice the greatest age), by cells of ``side`` degrees that hold facts of
    the key and that the instant's ``area`` with ``pad_m`` metres around it touches, and by one
    of ``salts`` numbers of the key, so no join key gathers much of either side.

    Rows hold the fact's columns, ``instant_key``, sensed_us and the area; ``within`` may read
    any column of both sides. It is tested on the fact that was found. Only where it fails, and the key has other
    places around that time, are the key's facts within the greatest age looked through.
    """
    base = [instant_key, "sensed_us", *(area or ())]
    found = nearest_spans(facts, instants, key, max_age_us, instant_key, area, pad_m, side, slots, salts)
    rows = [key, *(c for c in facts.columns if c != key), *base]
    if within is None:
        return found.select(*rows)
    more = instants.select(instant_key, *(c for c in instants.columns if c not in base))  # what only ``within`` reads
    told = found.select(*rows, "_several").join(more, instant_key).withColumn("_within", F.coalesce(within, F.lit(False)))
    told = stable(told.select(*rows, "_several", "_within"))
    met, failed = told.filter("_within").select(*rows), told.filter("_several and not _within").select(key, instant_key)
    if not failed.head(1):
        return met
    return met.unionByName(look_through(failed.join(instants, instant_key), facts, key, max_age_us, instant_key, within).select(*rows))


def nearest_spans(facts: DataFrame, instants: DataFrame, key: str, max_age_us: int, instant_key: str, area: tuple[str, str, str, str] | None = None, pad_m: float = 0.0, side: float = 2.0, slots: int = 12, salts: int = 64) -> DataFrame:
    """The as-of join of ``nearest_in_time`` before anything is tested, with the columns of ``reigns``."""
    slot = lambda c: F.floor(c / F.lit(max(1, 2 * max_age_us // slots))).cast("long")
    base = [instant_key, "sensed_us", *(area or ())]
    on, i = ["_s", "_salt"], instants.select(*base).withColumn("_s", slot(F.col("sensed_us"))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spans = reigns(facts, key, max_age_us, side, instants).withColumn("_s", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to"))))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    if area is not None:
        xs, ys = box_cells(area, pad_m, side)
        i = i.withColumn("_xs", xs).withColumn("_ys", ys).withColumn("_x", F.explode("_xs")).withColumn("_y", F.explode("_ys"))
        spans = spans.withColumn("_c", F.explode("_cells")).select("*", F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"))
        on += ["_x", "_y"]
    found = spans.join(i, on).filter(F.col("sensed_us").between(F.col("_from"), F.col("_to")))
    if area is not None:  # where several cells of the key are touched, the first of them counts
        inside = lambda c: c["x"].between(F.col("_xs")[0], F.element_at("_xs", -1)) & c["y"].between(F.col("_ys")[0], F.element_at("_ys", -1))
        found = found.filter((F.size("_cells") == 1) | (F.col("_c") == F.filter("_cells", inside)[0]))
    return found


def look_through(asked: DataFrame, facts: DataFrame, key: str, max_age_us: int, instant_key: str, within: Column) -> DataFrame:
    """Per row of ``asked`` (``key``, ``instant_key``, sensed_us and what ``within`` reads), the nearest in time of all the key's facts that are ``within``."""
    asked, width = stable(asked), _LOOKED * max(1, max_age_us)
    # the few that are asked are put in every bucket they may need, facts of the keys that are asked for in their own
    around = facts.join(stable(asked.select(key).distinct()), key, "left_semi").withColumn("_b", _bucket(F.col("time_us"), width))
    age = F.abs(F.col("time_us") - F.col("sensed_us"))
    others = asked.withColumn("_b", _buckets_around("sensed_us", max_age_us, width)).join(around, [key, "_b"]).filter(age <= max_age_us).filter(within)
    # twice the distance in time, odd after the instant: the earlier of two equally far ones is less
    rank = age * 2 + F.when(F.col("time_us") > F.col("sensed_us"), 1).otherwise(0)
    rows = [c for c in dict.fromkeys([*asked.columns, *facts.columns]) if c != "_b"]
    return others.groupBy(instant_key, key).agg(F.min_by(F.struct(*rows), F.struct(rank, F.col("id"))).alias("row")).select("row.*")


def match_counts(left: DataFrame, right: DataFrame, metres: float, on: list[str]) -> DataFrame:
    """Per group: how many left points have a right point within ``metres``, how many have none, and the reverse."""
    r = right.withColumnRenamed("lon", "r_lon").withColumnRenamed("lat", "r_lat")
    l = left.withColumnRenamed("lon", "r_lon").withColumnRenamed("lat", "r_lat")  # noqa: E741
    hit = lambda a, b: within_distance(a, b, F.lit(metres), on, "left_semi").groupBy(*on).agg(F.count("*").alias("n"))
    count = lambda d, n: d.groupBy(*on).agg(F.count("*").alias(n))
    out = count(left, "left_all").join(count(right, "right_all"), on, "full_outer")
    out = out.join(hit(left, r).withColumnRenamed("n", "left_hit"), on, "left").join(hit(right, l).withColumnRenamed("n", "right_hit"), on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*on, zero("left_hit").alias("left_hit"), (zero("left_all") - zero("left_hit")).alias("left_miss"), zero("right_hit").alias("right_hit"), (zero("right_all") - zero("right_hit")).alias("right_miss"))
