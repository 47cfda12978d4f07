"""Matching particle tables by name, by rounded place and by distance.

Distance joins bin the plane into cells and bring a point into every cell
within its reach. The right side is first brought down to what can decide the
answer, so the work does not grow with the square of a crowded cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from orientlake.frames import ColumnRoles, require_columns
from orientlake.functions import strings as S
from orientlake.operators.ordered import ordered_rank, small_parts
from orientlake.session import cut

CROWDED_CELL = 4096
MET_IN_CELL = 64


class NoMatch(ValueError):
    """Two tables share no particle under the rule that was asked for."""


def is_unique(df: DataFrame, *key: str) -> bool:
    return df.groupBy(*key).count().where("count > 1").isEmpty()


def _sure_id(image: str) -> Column:
    return F.coalesce(S.particle_id(F.col(image)), F.raise_error(F.concat(
        F.lit("an image name has no number: "), F.coalesce(F.col(image), F.lit("null")))).cast("string"))


def match_by_name(left: DataFrame, right: DataFrame, allow_partial: bool = True, image: str = "image_name",
                  suffix: str = "_2", parts: int | None = None) -> DataFrame:
    """Rows of both tables with the same particle id, side by side.

    Both are dealt into ``parts`` by the id where that is given, so that long
    tables are sorted in memory.

    Right columns get ``suffix``. In strict mode both tables must hold the
    same ids. An id that stands twice in the right table is an error when the
    result is read; its rows are counted, never paired. The count shares the
    partitioning of the join. A name without an image number has no id, which
    is an error in either table and no silent loss.
    """
    a = left.withColumn("particle_id", _sure_id(image))
    b = right.withColumn("particle_id", _sure_id(image))
    if parts:
        a, b = a.repartition(parts, "particle_id"), b.repartition(parts, "particle_id")
    if not allow_partial:
        ids = a.select("particle_id", F.lit(1).alias("_l")).join(b.select("particle_id", F.lit(1).alias("_r")), "particle_id", "full_outer")
        only = ids.agg(F.count(F.when(F.col("_r").isNull(), 1)).alias("l"), F.count(F.when(F.col("_l").isNull(), 1)).alias("r")).first()
        if only["l"] or only["r"]:
            raise NoMatch(f"different particles: {only['l']} only in the first, {only['r']} only in the second table")
    once = b.groupBy("particle_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c + suffix) for c in right.columns])
    single = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("particle id stands twice in the second table: "), F.col("particle_id"))).cast("boolean"))
    return a.join(once.where(single).drop("_n"), "particle_id")


@dataclass(frozen=True)
class Place:
    """How a table says where a particle lies."""
    micrograph: str = "micrograph"
    x: str = "x"
    y: str = "y"
    scale: float = 1.0

    @classmethod
    def of(cls, df: DataFrame, scale: float = 1.0) -> "Place":
        return cls(*ColumnRoles.of(df).place(), scale)

    def columns(self) -> list[Column]:
        return [S.micrograph_key(F.col(self.micrograph)).alias("mic"),
                (F.col(self.x).cast("double") * self.scale).alias("px"),
                (F.col(self.y).cast("double") * self.scale).alias("py")]


def _cell(c: str, width: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(width)))


def _reaching(df: DataFrame, reach: float, cell: float) -> DataFrame:
    """Each point once for every cell that lies within reach of it: mostly one, up to four.

    Cells are at least twice as wide as the reach. The reach is taken a trifle
    wider than asked, so that rounding cannot lose a point on the border; the
    distance test that follows is exact.
    """
    wide = reach * (1 + 1e-9) + 1e-9
    def cells(c):
        return F.explode(F.array_distinct(F.array(F.floor((F.col(c) - wide) / cell), F.floor((F.col(c) + wide) / cell))))
    return df.withColumn("bx", cells("px")).withColumn("by", cells("py"))


def _deciding_points(right: DataFrame, margin: float) -> DataFrame:
    """The right points that can decide whether a left row has any neighbour, per cell they serve.

    Within one cell all points are close enough, so one does. For a cell
    beside, the point nearest the shared edge does. For a cell across a
    corner, a point counts only if none is nearer in x and in y: walking away
    from the corner in x, those that come nearer in y than all before them.
    All are real points, so the plain distance test stays exact, and a crowded
    cell is sorted once instead of being given to its corners whole.
    """
    columns = (right.withColumns({"bx": _cell("px", margin), "by": _cell("py", margin)})
               .groupBy("mic", "bx", "by", "px").agg(F.min("py").alias("lo"), F.max("py").alias("hi")))
    low = F.struct(F.col("px").alias("px"), F.col("lo").alias("py"))
    by_y_low, by_y_high = F.struct(F.col("lo").alias("py"), F.col("px").alias("px")), F.struct(F.col("hi").alias("py"), F.col("px").alias("px"))
    edges = columns.groupBy("mic", "bx", "by").agg(
        F.min(low).alias("w"), F.max(low).alias("e"), F.min(by_y_low).alias("s"), F.max(by_y_high).alias("n"))

    def row(c: str, i: int, j: int) -> Column:
        return F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{c}.px").alias("px"), F.col(f"{c}.py").alias("py"))

    beside = edges.select("mic", "bx", "by", F.inline(F.array(
        row("w", 0, 0), row("w", -1, 0), row("e", 1, 0), row("s", 0, -1), row("n", 0, 1))))
    cell = Window.partitionBy("mic", "bx", "by")
    before = {-1: cell.orderBy("px").rowsBetween(Window.unboundedPreceding, -1), 1: cell.orderBy(F.desc("px")).rowsBetween(Window.unboundedPreceding, -1)}
    walked = columns.select("*", *[c for i, w in before.items() for c in (F.min("lo").over(w).alias(f"lo{i}"), F.max("hi").over(w).alias(f"hi{i}"))])
    steps = []
    for i in (-1, 1):
        for j, c, nearer in ((-1, "lo", F.col("lo") < F.col(f"`lo{i}`")), (1, "hi", F.col("hi") > F.col(f"`hi{i}`"))):
            point = F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("px").alias("px"), F.col(c).alias("py"))
            steps.append(F.when(F.coalesce(nearer, F.lit(True)), point))
    across = walked.select("mic", "bx", "by", F.inline(F.array_compact(F.array(*steps))))
    return beside.unionByName(across).select("mic", (F.col("bx") + F.col("i")).alias("bx"), (F.col("by") + F.col("j")).alias("by"), "px", "py")


def near_any(left: DataFrame, right: DataFrame, margin: float, keep: bool = True,
             left_place: Place | None = None, right_place: Place | None = None) -> DataFrame:
    """Left rows with (``keep``) or without a right row in the inclusive box of half-width ``margin``."""
    lp, rp = left_place or Place.of(left), right_place or Place.of(right)
    # from one pixel on, a cell as wide as the margin needs only its deciding points
    few = margin >= 1.0
    width = float(margin) if few else max(4.0 * margin, 1.0)
    a = left.select("*", *[c for c in lp.columns()])
    a = a.withColumns({"_bx": _cell("px", width), "_by": _cell("py", width)}).withColumnsRenamed(
        {"mic": "_mic", "px": "_px", "py": "_py"})
    points = right.select(*rp.columns())
    b = _deciding_points(points, width) if few else _reaching(points.distinct(), margin, width)
    test = ((F.col("_mic") == F.col("mic")) & (F.col("_bx") == F.col("bx")) & (F.col("_by") == F.col("by"))
            & (F.abs(F.col("_px") - F.col("px")) <= margin) & (F.abs(F.col("_py") - F.col("py")) <= margin))
    return a.join(b, test, "left_semi" if keep else "left_anti").drop("_mic", "_px", "_py", "_bx", "_by")


def _nearest_places(left: DataFrame, right: DataFrame, right_id: str, margin: float, metric: str, lp: Place, rp: Place) -> DataFrame:
    """(mic, px, py, distance, _r) for each distinct left place that has a right row inside the inclusive box.

    Equal places are merged on both sides, so repeated rows are searched once.
    When cells are crowded the search starts with a shorter reach on finer
    cells: a neighbour found within it is the nearest, and only places that
    found none go on to twice the reach. The least distance and then the
    lowest id at that distance are two plain minima, so no pair is ever sorted.
    """
    width = max(1.0, float(margin))
    place = ["mic", "px", "py"]
    open_places = left.select(*lp.columns()).distinct()
    points = cut(right.select(F.col(right_id).alias("_r"), *rp.columns()).groupBy(*place).agg(F.min("_r").alias("_r")), "points")
    cells = points.groupBy("mic", _cell("px", 4 * width), _cell("py", 4 * width)).count().agg(
        F.max("count").alias("most"), (F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).alias("met")).first()
    levels = 0
    while levels < 20 and max((cells["most"] or 0) / CROWDED_CELL, (cells["met"] or 0) / MET_IN_CELL) > 4 ** levels:
        levels += 1
    if levels:
        open_places = cut(open_places, "places")
    found = None
    for level in range(levels, -1, -1):
        reach = width / 2 ** level
        b = _reaching(points, reach, 4 * reach).withColumnsRenamed({"px": "qx", "py": "qy"})
        dx, dy = F.abs(F.col("px") - F.col("qx")), F.abs(F.col("py") - F.col("qy"))
        dist = F.sqrt(dx * dx + dy * dy) if metric == "euclid" else F.greatest(dx, dy)

        def pairs(a: DataFrame) -> DataFrame:
            own = a.withColumns({"bx": _cell("px", 4 * reach), "by": _cell("py", 4 * reach)})
            return own.join(b, ["mic", "bx", "by"]).where((dx <= margin) & (dy <= margin)).withColumn("_d", dist)

        close = pairs(open_places)
        if level:
            close = close.where(F.col("_d") <= reach)
        least = cut(close.groupBy(*place).agg(F.min("_d").alias("distance")), "least")
        best = pairs(least).where(F.col("_d") == F.col("distance")).groupBy(*place, "distance").agg(F.min("_r").alias("_r"))
        found = best if found is None else found.unionByName(best)
        if level:
            open_places = cut(open_places.join(least.select(*place), place, "left_anti"), "places")
            if open_places.isEmpty():
                break
    return found


def nearest_in_box(left: DataFrame, right: DataFrame, left_id: str, right_id: str, margin: float,
                   metric: str = "euclid", left_place: Place | None = None, right_place: Place | None = None) -> DataFrame:
    """(left id, right id, distance) of the nearest right row inside the inclusive box, lowest id on ties."""
    lp, rp = left_place or Place.of(left), right_place or Place.of(right)
    found = _nearest_places(left, right, right_id, margin, metric, lp, rp)
    rows = left.select(F.col(left_id), *lp.columns())
    return rows.join(found, ["mic", "px", "py"]).select(left_id, F.col("_r").alias(f"{right_id}_2"), "distance")


def match_by_coordinates(left: DataFrame, right: DataFrame, row_id: str, margin: float = 5.0,
                         scale1: float = 1.0, scale2: float = 1.0, suffix: str = "_2") -> DataFrame:
    """Left rows beside their nearest right row within the margin; a right row may serve several."""
    place = {"mic": "_mic", "px": "_px", "py": "_py"}
    found = _nearest_places(left, right, row_id, margin, "euclid", Place.of(left, scale1), Place.of(right, scale2))
    found = found.withColumnsRenamed({**place, "_r": row_id + suffix})
    rows = left.select("*", *_placed_as(left, scale1, place))
    renamed = right.select(*[F.col(c).alias(c + suffix) for c in right.columns])
    return rows.join(found, list(place.values())).drop(*place.values()).join(renamed, row_id + suffix)


def _placed_as(df: DataFrame, scale: float, names: dict[str, str]) -> list[Column]:
    return [c.alias(n) for c, n in zip(Place.of(df, scale).columns(), names.values())]


def match_auto(left: DataFrame, right: DataFrame, row_id: str, margin: float = 5.0,
               scale1: float = 1.0, scale2: float = 1.0, image: str = "image_name") -> DataFrame:
    """By particle id when any id is shared, else by coordinates."""
    if image in left.columns and image in right.columns:
        ids = right.select(S.particle_id(F.col(image)).alias("_p"))
        if not left.select(S.particle_id(F.col(image)).alias("_p")).join(ids, "_p", "left_semi").isEmpty():
            return match_by_name(left, right, image=image)
    return match_by_coordinates(left, right, row_id, margin, scale1, scale2)


def place_key(df: DataFrame, tolerance: float) -> list[Column]:
    """(micrograph, rounded x, rounded y) as three join keys."""
    mic, x, y = ColumnRoles.of(df).place()
    return [S.micrograph_key(F.col(mic)).alias("mic"), S.coordinate_cell(F.col(x), tolerance).alias("cx"),
            S.coordinate_cell(F.col(y), tolerance).alias("cy")]


def shared_places(tables: list[DataFrame], row_id: str, tolerance: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Row ids of the particles found in every table, one column ``id_<i>`` per table.

    Columns in ``carry`` come along as ``<column>_<i>``, so one shuffle serves
    match and values. A place used twice within one table breaks the
    one-to-one match and raises an error when the result is read. Places are
    nearly all distinct in a table, so rows are dealt by their place as they
    are, into parts that are sorted in memory, and merged where they arrive.
    """
    all_rows = None
    for i, t in enumerate(tables):
        rows = t.select(F.lit(i).alias("file"), F.struct(F.col(row_id).alias("id"), *carry).alias("_v"), *place_key(t, tolerance))
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    aggs = []
    for i in range(len(tables)):
        mine = F.col("file") == i
        aggs += [F.count(F.when(mine, 1)).alias(f"n_{i}"), F.min(F.when(mine, F.col("_v"))).alias(f"v_{i}")]
    merged = all_rows.repartition(small_parts(all_rows), "mic", "cx", "cy").groupBy("mic", "cx", "cy").agg(*aggs)
    for i in range(len(tables)):
        merged = merged.where(F.col(f"n_{i}") > 0)
    worst = F.greatest(*[F.col(f"n_{i}") for i in range(len(tables))])
    one = F.when(worst == 1, F.col("v_0.id")).otherwise(F.raise_error(F.lit("a place is used twice in one table")).cast("bigint"))
    return merged.select("mic", "cx", "cy", one.alias("id_0"), *[F.col(f"v_{i}.id").alias(f"id_{i}") for i in range(1, len(tables))],
                         *[F.col(f"v_{i}.{c}").alias(f"{c}_{i}") for i in range(len(tables)) for c in carry])


def set_difference(everything: DataFrame, good: DataFrame, row_id: str, margin: float = 5.0,
                   scale_all: float = 1.0, scale_good: float = 1.0) -> DataFrame:
    """Rows of ``everything`` with column ``is_good``.

    Exact (micrograph, x, y) keys decide if any is shared. Otherwise the
    margin widens over fixed steps until enough rows are near a good row; one
    distance join at the widest step serves all of them. Not a single row left
    over, or none that is good, is an error.
    """
    key = ["mic", "px", "py"]
    exact = good.select(*Place.of(good, 1.0).columns()).distinct()
    keyed = everything.select("*", *Place.of(everything, 1.0).columns())
    if not keyed.join(exact, key, "left_semi").isEmpty():
        marked = keyed.join(exact.withColumn("_g", F.lit(True)), key, "left")
        return _with_rest(cut(marked.withColumn("is_good", F.coalesce("_g", F.lit(False))).drop("_g", *key), "difference"))
    # Margins that are tried after the given one, and the share of good rows to reach.
    steps = sorted({float(margin), 10.0, 25.0, 50.0, 100.0})
    wanted = int(0.80 * good.count())
    place = {"mic": "_mic", "px": "_px", "py": "_py"}
    found = _nearest_places(everything, good, row_id, steps[-1], "box", Place.of(everything, scale_all), Place.of(good, scale_good))
    found = found.drop("_r").withColumnsRenamed({**place, "distance": "_near"})
    rows = everything.select("*", *_placed_as(everything, scale_all, place))
    near = cut(rows.join(found, list(place.values()), "left").drop(*place.values()), "near")
    counts = near.agg(*[F.count(F.when(F.col("_near") <= s, 1)).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    chosen = next((s for i, s in enumerate(steps) if counts[i] >= wanted and counts[i] > 0), None)
    if chosen is None:
        raise NoMatch(f"fewer than 80% of the good rows found within {steps[-1]} px")
    return _with_rest(near.withColumn("is_good", F.coalesce(F.col("_near") <= chosen, F.lit(False))).drop("_near"))


def _with_rest(rows: DataFrame) -> DataFrame:
    """The same rows, if there are some that are not good."""
    if rows.where(~F.col("is_good")).isEmpty():
        raise NoMatch("all rows are good: nothing is left over")
    return rows


def merge_truth(truth: DataFrame, predicted: DataFrame, key: str, row_no: str | None = None,
                angles: tuple[str, ...] = ("rot", "tilt", "psi")) -> DataFrame:
    """Predictions beside the truth; colliding truth columns get ``_gt``.

    By ``key`` if it is shared, else by micrograph and coordinates to 0.01
    pixels, else (no common key column, equal length) by row order.
    """
    def renamed(df, keys):
        return df.select(*keys, *[F.col(c).alias(c + "_gt" if c in predicted.columns else c)
                                  for c in df.columns if c not in keys])

    if key in truth.columns and key in predicted.columns:
        if not predicted.select(key).join(truth.select(key), key, "left_semi").isEmpty():
            return predicted.join(renamed(truth, [key]), key)
        cells = [c.alias(f"_{n}") for c, n in zip(place_key(predicted, 0.01), ("m", "x", "y"))]
        names = ["_m", "_x", "_y"]
        return predicted.select("*", *cells).join(
            renamed(truth.select("*", *[c.alias(n) for c, n in zip(place_key(truth, 0.01), names)]), names), names).drop(*names)
    if row_no is None or truth.count() != predicted.count():
        raise NoMatch(f"no common column {key}, and tables of different length or without row order")
    require_columns(truth, angles, "truth")
    a = ordered_rank(predicted, row_no, "_k").drop("_k_total")
    b = ordered_rank(truth.select(row_no, *angles), row_no, "_k").select("_k", *[F.col(c).alias(c + "_gt") for c in angles])
    return a.join(b, "_k").drop("_k")


def match_diagnostics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per micrograph basename: rows and coordinate ranges on each side, also where only one side has it."""
    def ranges(df, tag):
        return df.select(*Place.of(df).columns()).groupBy("mic").agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.min("px").alias(f"x_min_{tag}"), F.max("px").alias(f"x_max_{tag}"),
            F.min("py").alias(f"y_min_{tag}"), F.max("py").alias(f"y_max_{tag}"))
    both = ranges(left, "all").join(ranges(right, "good"), "mic", "full_outer")
    return both.withColumn("shared", F.col("n_all").isNotNull() & F.col("n_good").isNotNull())


def optics_mismatches(matched: DataFrame, optics_a: DataFrame, optics_b: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """Pairs of optics groups used by matched particles whose shared columns differ, NULL equal to NULL."""
    shared = [c for c in optics_a.columns if c in optics_b.columns and c != "optics_group"]
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in shared]))
    a = optics_a.select(F.col("optics_group").alias(group_a), text.alias("text_a"))
    b = optics_b.select(F.col("optics_group").alias(group_b), text.alias("text_b"))
    used = matched.groupBy(group_a, group_b).agg(F.count(F.lit(1)).alias("n"))
    return used.join(a, group_a).join(b, group_b).where(~F.col("text_a").eqNullSafe(F.col("text_b")))


def bring_columns(base: DataFrame, other: DataFrame, key: list[str], columns: list[str], file_no: int) -> DataFrame:
    """Columns of another table on matching rows, named ``<column>_file<i>``."""
    return base.join(other.select(*key, *[F.col(c).alias(f"{c}_file{file_no}") for c in columns]), key, "left")


def upsert(base: DataFrame, new: DataFrame, key: str, columns: list[str], keep_old: list[str] = (), only_new: bool = False) -> DataFrame:
    """New values over old ones; old values in ``keep_old`` stay as ``<column>_ori``.

    Ids of the new rows must be unique.
    """
    if not is_unique(new, key):
        raise ValueError(f"duplicate {key} among new rows")
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.withColumns({f"{c}_ori": F.col(c) for c in keep_old}).join(n, key, "inner" if only_new else "left")
    return joined.withColumns({
        c: F.coalesce(f"_new_{c}", c) if c in base.columns else F.col(f"_new_{c}") for c in columns
    }).drop(*[f"_new_{c}" for c in columns])


HALF_POLICIES = ("matching", "all", "explicit")


def half_pairs(df: DataFrame, policy: str, explicit: tuple[tuple[int, int], ...] = (), half: str = "half") -> DataFrame:
    """Every row with each model half it is to be scored with, as ``model_half``."""
    if policy not in HALF_POLICIES:
        raise ValueError(f"policy must be one of {HALF_POLICIES}")
    pairs = {"matching": ((1, 1), (2, 2)), "all": ((1, 1), (1, 2), (2, 1), (2, 2)), "explicit": tuple(explicit)}[policy]
    models = F.filter(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(m).alias("m")) for d, m in pairs]),
                      lambda p: p["d"] == F.col(half))
    return df.withColumn("_m", F.explode(models)).withColumn("model_half", F.col("_m.m")).drop("_m")
