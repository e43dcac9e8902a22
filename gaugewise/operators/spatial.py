"""Nearest point on the sphere, by descending an octree of candidate cells.

Comparing every point with every candidate is quadratic, and so is comparing the points of
one crowded map cell. Instead each point keeps a short list of cells that can still hold its
nearest candidate. Going STEP levels down replaces a cell by its occupied descendants and
drops those whose bounding box is farther away than the farthest corner of the best one.
Points at one place, such as the sensors of a station, descend as one.
Every step is one equi-join on the cell with a bounded number of descendants per row, and
only the few cells left at the bottom are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.geo import chord, haversine_m, with_unit_vector
from gaugewise.operators import skew
from gaugewise.operators.skew import attach, settle

#: Cells are divided until none holds more distinct places than this, or MAX_LEVEL is reached (12 m).
LEAF_SIZE = 64
MAX_LEVEL = 20
STEP = 2
#: Down to this level the table of occupied cells has at most 8**4 rows and is broadcast.
BROADCAST_LEVEL = 4

_AXES = ("_x", "_y", "_z")
_CELLS = [f"c{a}" for a in _AXES]


def _with_cells(places: DataFrame) -> DataFrame:
    """Adds the cell of every place at MAX_LEVEL; coarser cells follow by shifting bits."""
    cells = 2**MAX_LEVEL
    return places.selectExpr(
        "*", *[f"CAST(least(floor(({a} + 1) / 2 * {cells}), {cells - 1}) AS BIGINT) AS c{a}" for a in _AXES]
    )


def _depth(places: DataFrame) -> int:
    """First level at which no cell is crowded (one row per level reaches the driver)."""
    shifted = [f"shiftright({c}, {MAX_LEVEL} - level) AS {c}" for c in _CELLS]
    crowding = (
        places.withColumn("level", F.explode(F.sequence(F.lit(STEP), F.lit(MAX_LEVEL), F.lit(STEP))))
        .selectExpr("level", *shifted)
        .groupBy("level", *_CELLS)
        .count()
        .groupBy("level")
        .agg(F.max("count").alias("most"))
        .collect()
    )
    return min((row["level"] for row in crowding if row["most"] <= LEAF_SIZE), default=MAX_LEVEL)


def _occupied(places: DataFrame, level: int) -> DataFrame:
    """Occupied cells of a level: their tight bounding boxes and the cell STEP levels up."""
    boxes = [f"min({a}) AS lo{a}" for a in _AXES] + [f"max({a}) AS hi{a}" for a in _AXES]
    cells = (
        places.selectExpr(*_AXES, *[f"shiftright({c}, {MAX_LEVEL - level}) AS {c}" for c in _CELLS])
        .groupBy(*_CELLS)
        .agg(*map(F.expr, boxes))
        .selectExpr("*", *[f"shiftright(c{a}, {STEP}) AS p{a}" for a in _AXES])
    )
    return F.broadcast(cells) if level <= BROADCAST_LEVEL else cells


def _top_cells(places: DataFrame) -> str | None:
    """SQL text that gives every point all occupied cells of the first step (at most 64); None if there are none."""
    columns = _CELLS + [f"{side}{a}" for a in _AXES for side in ("lo", "hi")]
    cells = _occupied(places, STEP).select(*columns).collect()
    structs = [
        "struct("
        + ", ".join(f"{row[c]}L AS {c}" if c in _CELLS else f"CAST({row[c]!r} AS DOUBLE) AS {c}" for c in columns)
        + ")"
        for row in cells
    ]
    return f"inline(array({', '.join(structs)}))" if structs else None


def nearest(
    points: DataFrame,
    candidates: DataFrame,
    max_dist_m: float | None = None,
    point_id: str = "gpi",
    candidate_id: str = "other_gpi",
) -> DataFrame:
    """Nearest candidate of every point: ``point_id``, ``candidate_id``, ``distance_m``.

    Both inputs have ``gpi``, ``lon``, ``lat``. Points without a candidate within
    ``max_dist_m`` are absent. Candidates at the same distance (to the millimetre) are
    decided by the smaller id.
    """
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    # candidates at one place compete by id alone, so only the smallest id has to travel
    distinct = candidates.where(located).groupBy("lon", "lat").agg(F.min("gpi").alias(candidate_id))
    places = settle(_with_cells(with_unit_vector(distinct)))
    depth = _depth(places)

    near_sq = " + ".join(f"power(greatest(lo{a} - {a}, {a} - hi{a}, 0D), 2)" for a in _AXES)
    far_sq = " + ".join(f"power(greatest(abs({a} - lo{a}), abs(hi{a} - {a})), 2)" for a in _AXES)
    limit = 5.0 if max_dist_m is None else chord(max_dist_m) ** 2
    # the margins keep rounding from pruning a cell that is exactly as far as the bound
    within = "_near <= _bound * (1 + 1e-9D) + 1e-15D"
    kept = ["lon", "lat", *_AXES]
    parents = [f"p{a}" for a in _AXES]
    top = _top_cells(places)
    if top is None:
        # no candidate anywhere
        return points.where(F.lit(False)).selectExpr(
            f"gpi AS `{point_id}`", f"CAST(NULL AS BIGINT) AS `{candidate_id}`", "CAST(NULL AS DOUBLE) AS distance_m"
        )
    # points at one place share the answer, so a place descends once
    here = points.where(located).select(F.col("gpi").alias(point_id), "lon", "lat")
    sites = settle(here.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n")))
    start = with_unit_vector(sites.select("lon", "lat"))
    frontier = start.selectExpr(*kept, f"CAST({limit!r} AS DOUBLE) AS _bound", top)

    many = depth > BROADCAST_LEVEL and sites.count() > skew.FLOOR

    def descend(rows: DataFrame, below: DataFrame, level: int) -> DataFrame:
        """Rows joined with what lies below their cell; with many points, crowded cells are salted."""
        if level <= BROADCAST_LEVEL or not many:
            return rows.join(below, parents)
        rows = settle(rows)
        return attach(rows, below.join(rows.groupBy(*parents).agg(F.count(F.lit(1)).alias("n")), parents), parents)

    for level in range(STEP, depth + 1, STEP):
        cells = frontier if level == STEP else descend(frontier, _occupied(places, level), level)
        frontier = (
            cells.selectExpr(*kept, *_CELLS, "_bound", f"{near_sq} AS _near", f"{far_sq} AS _far")
            .where(within)
            # a place has few cells left, so this window is over a handful of rows
            .withColumn("_bound", F.expr("least(_bound, min(_far) OVER (PARTITION BY lon, lat))"))
            .where(within)
            .selectExpr(*kept, *[f"c{a} AS p{a}" for a in _AXES], "_bound")
        )
    opened = places.selectExpr(
        f"`{candidate_id}`",
        "lon AS _lon",
        "lat AS _lat",
        *[f"shiftright(c{a}, {MAX_LEVEL - depth}) AS p{a}" for a in _AXES],
    )
    best = (
        descend(frontier, opened, depth)
        .selectExpr(
            "lon",
            "lat",
            f"struct(round({haversine_m('lon', 'lat', '_lon', '_lat')}, 3) AS d, `{candidate_id}` AS id) AS _hit",
        )
        .groupBy("lon", "lat")
        .agg(F.min("_hit").alias("_hit"))
    )
    best = (
        attach(here, best.join(sites, ["lon", "lat"]), ["lon", "lat"])
        .groupBy(point_id)
        .agg(F.min("_hit").alias("_hit"))
        .select(point_id, F.col("_hit.id").alias(candidate_id), F.col("_hit.d").alias("distance_m"))
    )
    return best if max_dist_m is None else best.where(F.col("distance_m") <= float(max_dist_m))
