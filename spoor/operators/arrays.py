"""Dense arrays as long voxel tables (t, z, y, x, value): maxima, averages, painting, intensities."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import percentiles
from ..functions.roi import distance2

SPACE = ("z", "y", "x")


def local_maxima(voxels: DataFrame, window: tuple[int, int, int]) -> DataFrame:
    """``voxels`` with ``pooled``, the greatest value in the window around each, and ``maximum``, whether it has it itself.

    Three windows in turn, one a dimension. Absent voxels do not count, so the
    passes run over the lines that the values' neighbourhood needs: every voxel
    is first dealt to the places of the window in the other two dimensions.
    """
    reach = [w // 2 for w in window]
    spread = voxels.select("t", "z", "y", "x", "value")
    for d, k in zip(SPACE, reach):
        others = [c for c in ("t", *SPACE) if c != d]
        moved = spread.withColumn("_s", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn(d, F.col(d) + F.col("_s")).drop("_s")
        spread = moved.groupBy(*others, d).agg(F.max("value").alias("value"))
    pooled = spread.select("t", *SPACE, F.col("value").alias("pooled"))
    return voxels.join(pooled, ["t", *SPACE]).withColumn("maximum", F.col("value") == F.col("pooled"))


def maxima_to_cells(voxels: DataFrame, threshold: float, begin=(0, 0, 0), voxel_size=(1, 1, 1), shape=None, z_range=None, mask: DataFrame | None = None) -> DataFrame:
    """Cells of the maxima above the threshold: world places, inside the volume, off the mask's zeros, within the inclusive z range."""
    out = voxels.filter(F.col("maximum") & (F.col("value") > threshold))
    if shape is not None:
        for d, s in zip(SPACE, shape):
            out = out.filter(F.col(d) < s)
    if z_range is not None:
        out = out.filter(F.col("z").between(*z_range))
    if mask is not None:
        out = out.join(mask.filter("value = 0"), ["t", *SPACE], "left_anti")
    return out.select(cantor("t", *SPACE).alias("id"), "t", *[(F.col(d) * float(v) + float(b)).alias(d) for d, v, b in zip(SPACE, voxel_size, begin)], F.col("value").alias("score"))


def cantor(*columns: str) -> Column:
    """Nested pairing (a+b)(a+b+1)/2+b of whole non-negative numbers, in exact decimals until the end."""
    out = F.col(columns[0]).cast("decimal(38,0)")
    for c in columns[1:]:
        b = F.col(c).cast("decimal(38,0)")
        total = (out + b).cast("decimal(18,0)")
        out = ((total * (total + 1) / 2).cast("decimal(38,0)") + b).cast("decimal(38,0)")
    return out.cast("bigint")


def average_motion(motion: DataFrame, centres: DataFrame, edge: int) -> DataFrame:
    """(id, mv_z, mv_y, mv_x): the mean over the cube of odd ``edge`` around each centre of motion + offset to the centre; cut off at the volume's border."""
    k = edge // 2
    near = centres.select(F.col("id").alias("cid"), "t", *[F.explode(F.sequence(F.col(d) - k, F.col(d) + k)).alias(d) if d == "z" else F.col(d) for d in SPACE], *[F.col(d).alias("c_" + d) for d in SPACE])
    for d in ("y", "x"):
        near = near.withColumn(d, F.explode(F.sequence(F.col("c_" + d) - k, F.col("c_" + d) + k)))
    found = near.join(motion, ["t", *SPACE])
    return found.groupBy(F.col("cid").alias("id")).agg(*[F.avg(F.col("mv_" + d) + F.col(d) - F.col("c_" + d)).alias("mv_" + d) for d in SPACE])


def rasterize_points(nodes: DataFrame, voxel_size=(1.0, 1.0, 1.0)) -> DataFrame:
    return nodes.select("t", *[F.floor(F.col(d) / v).cast("bigint").alias(d) for d, v in zip(SPACE, voxel_size)]).distinct()


def ball_voxels(nodes: DataFrame, radius: float, extra=()) -> DataFrame:
    """Whole-number voxels within ``radius`` of each node: (id, t, z, y, x, extra)."""
    reach = floor(radius) + 1
    out = nodes.select("id", "t", *[F.col(d).alias("c_" + d) for d in SPACE], *extra)
    for d in SPACE:
        out = out.withColumn(d, F.explode(F.sequence((F.floor("c_" + d) - reach).cast("bigint"), (F.floor("c_" + d) + reach).cast("bigint"))))
    inside = sum(((F.col(d) - F.col("c_" + d)) * (F.col(d) - F.col("c_" + d)) for d in SPACE[1:]), (F.col("z") - F.col("c_z")) * (F.col("z") - F.col("c_z")))
    return out.filter(inside <= radius * radius)


def paint_motion(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(t, z, y, x, mv_z, mv_y, mv_x): around each node with a parent, the vector from the voxel to the parent; later nodes paint over earlier."""
    parent = nodes.select(F.col("id").alias("target"), *[F.col(d).alias("p_" + d) for d in SPACE])
    moving = nodes.join(edges, F.col("id") == F.col("source")).join(parent, "target")
    spots = ball_voxels(moving, radius, extra=["p_z", "p_y", "p_x"])
    vector = F.struct(*[(F.col("p_" + d) - F.col(d)).alias("mv_" + d) for d in SPACE])
    return spots.groupBy("t", *SPACE).agg(F.max_by(vector, "id").alias("v")).select("t", *SPACE, "v.mv_z", "v.mv_y", "v.mv_x")


def motion_mask(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(t, z, y, x) of the voxels that ``paint_motion`` gives a vector."""
    return paint_motion(nodes, edges, radius).select("t", *SPACE)


def average_radius(nodes: DataFrame, default: float) -> DataFrame:
    """(t, radius): the mean of a frame's own radii (nulls left out), rounded up; the default where a frame has none."""
    return nodes.groupBy("t").agg(F.coalesce(F.ceil(F.avg("radius")).cast("double"), F.lit(float(default))).alias("radius"))


def rasterize_balls(nodes: DataFrame, radius: float, labels: DataFrame | None = None) -> DataFrame:
    """Voxels within ``radius`` of a node; with ``labels`` (t, z, y, x, label) only those of the label that is at the node's own voxel."""
    if labels is None:
        return ball_voxels(nodes, radius).select("t", *SPACE).distinct()
    own = nodes.select("id", "t", *[F.floor(d).cast("bigint").alias(d) for d in SPACE]).join(labels, ["t", *SPACE]).select("id", F.col("label").alias("own"))
    spots = ball_voxels(nodes, radius).join(own, "id").join(labels, ["t", *SPACE])
    return spots.filter("label = own").select("t", *SPACE).distinct()


def line_voxels(nodes: DataFrame, edges: DataFrame, voxel_size=(1.0, 1.0, 1.0)) -> DataFrame:
    """The columns of ``edges`` and (t, z, y, x): the voxels of a straight line in frame and space from each edge's target to its source.

    As many steps as the largest difference along an axis, each place rounded to
    the nearest voxel, halves to the even one. An edge with an end that is
    missing, or without a place, has no line.
    """
    axes = ("t", *SPACE)
    size = dict(zip(SPACE, voxel_size))
    at = lambda p: nodes.select(F.col("id").alias(p), *[(F.floor(F.col(a) / size[a]) if a in size else F.col(a)).cast("bigint").alias(f"_{p}_{a}") for a in axes]).dropna()
    ends = edges.join(at("source"), "source").join(at("target"), "target")
    steps = F.greatest(*[F.abs(F.col(f"_source_{a}") - F.col(f"_target_{a}")) for a in axes])
    walk = ends.withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    place = lambda a: F.rint(F.col(f"_target_{a}") + F.col("_k") * F.coalesce(F.try_divide(F.col(f"_source_{a}") - F.col(f"_target_{a}"), F.col("_n").cast("double")), F.lit(0.0))).cast("bigint").alias(a)
    return walk.select(*edges.columns, *[place(a) for a in axes])


def rasterize_graph(nodes: DataFrame, edges: DataFrame | None = None, voxel_size=(1.0, 1.0, 1.0), radius: float | None = None, hollow: float | None = None) -> DataFrame:
    """(t, z, y, x, label): nodes as voxels and edges as lines of voxels, as they are or grown to balls and tubes.

    ``nodes`` and ``edges`` carry their colour as ``label``; rows whose label is
    null are left out, tables without that column have label 1. Lines are painted
    over nodes, later ones (by id, or by source and target) over earlier ones.
    With ``radius``, in units of space, a voxel has the label of the nearest
    painted one of its frame, up to that distance between centres, of equally
    near ones the least; with ``hollow`` only beyond that share of the radius.
    Work and rows are those of the voxels painted, whatever the volume's size.
    """
    one = lambda d: d if "label" in d.columns else d.withColumn("label", F.lit(1).cast("bigint"))
    seen = one(nodes).filter("label is not null").dropna(subset=["id", "t", *SPACE])
    place = [F.col("t").cast("bigint").alias("t"), *[F.floor(F.col(d) / v).cast("bigint").alias(d) for d, v in zip(SPACE, voxel_size)]]
    order = lambda rank, a, b: F.struct(F.lit(rank).alias("rank"), F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).alias("order")
    spots = seen.select(*place, "label", order(0, "id", "id"))
    if edges is not None:
        lines = line_voxels(nodes, one(edges).filter("label is not null").select("source", "target", "label"), voxel_size)
        spots = spots.union(lines.select("t", *SPACE, "label", order(1, "source", "target")))
    painted = spots.groupBy("t", *SPACE).agg(F.max_by("label", "order").alias("label"))
    if radius is None:
        return painted
    around = painted.withColumn("_d2", F.lit(0.0))
    for d, v in zip(SPACE, voxel_size):
        reach = floor(radius / v)
        # What is already too far is dropped axis by axis, before the next axis multiplies it.
        around = around.withColumn("_o", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(d, F.col(d) + F.col("_o")).withColumn("_d2", F.col("_d2") + (F.col("_o") * v) * (F.col("_o") * v)).filter(F.col("_d2") <= radius * radius).drop("_o")
    grown = around.groupBy("t", *SPACE).agg(F.min(F.struct("_d2", "label")).alias("_near"))
    if hollow is not None:
        grown = grown.filter(F.col("_near._d2") > (hollow * radius) ** 2)
    return grown.select("t", *SPACE, F.col("_near.label").alias("label"))


def rasterize_peaks(nodes: DataFrame, sigma: float, reach: int) -> DataFrame:
    """Gaussian peaks, the sum over nodes scaled so that the greatest of a frame is 1."""
    spots = ball_voxels(nodes, float(reach))
    d2 = sum(((F.col(d) - F.col("c_" + d)) * (F.col(d) - F.col("c_" + d)) for d in SPACE[1:]), (F.col("z") - F.col("c_z")) * (F.col("z") - F.col("c_z")))
    summed = spots.groupBy("t", *SPACE).agg(F.sum(F.exp(-d2 / (2 * sigma * sigma))).alias("value"))
    top = summed.groupBy("t").agg(F.max("value").alias("top"))
    return summed.join(top, "t").select("t", *SPACE, (F.col("value") / F.col("top")).alias("value"))


# ---- intensities ---------------------------------------------------------


def normalize_around_zero(value: Column, mean: float | Column, scale: float | Column) -> Column:
    return ((value - mean) / scale).cast("float")


def normalize_lower_upper(value: Column, lower: float | Column, upper: float | Column) -> Column:
    return (value - lower) / (upper - lower)


def clip(value: Column, least: float | Column | None, most: float | Column | None) -> Column:
    if least is not None:
        value = F.greatest(value, least if isinstance(least, Column) else F.lit(float(least)))
    if most is not None:
        value = F.least(value, most if isinstance(most, Column) else F.lit(float(most)))
    return value


def normalize(values: DataFrame, kind: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``values`` (value) with ``normalized``: minmax, percminmax, mean or median. Bounds come from one aggregate row, percentiles from ranks."""
    exact = lambda *shares: [F.lit(v).cast("double") for v in percentiles(values, "value", list(shares))] if kind in ("percminmax", "median") else [F.lit(None)] * len(shares)
    lowest, middle, highest = exact(low, 0.5, high)
    one = lambda c: F.max(c)  # noqa: E731  (a constant, as an aggregate)
    aggregates = {
        "minmax": [F.min("value").alias("_a"), F.max("value").alias("_b")],
        "percminmax": [one(lowest).alias("_a"), one(highest).alias("_b")],
        "mean": [F.avg("value").alias("_a"), F.stddev_pop("value").alias("_b")],
        "median": [one(middle).alias("_a"), one(lowest).alias("_lo"), one(highest).alias("_hi"), F.stddev_pop("value").alias("_b")],
    }
    if kind not in aggregates:
        raise ValueError(f"unknown normalization {kind}")
    bounds = F.broadcast(values.agg(*aggregates[kind]))  # one row
    v, a, b = F.col("value"), F.col("_a"), F.col("_b")
    if kind == "minmax":
        out = normalize_lower_upper(clip(v, a / 2, b * 2), a, b)
    elif kind == "percminmax":
        out = normalize_lower_upper(v, a, b)
    elif kind == "mean":
        out = (v - a) / b
    else:
        out = (clip(v, F.col("_lo"), F.col("_hi")) - a) / b
    return values.join(bounds).withColumn("normalized", out).drop("_a", "_b", "_lo", "_hi")


def histogram_augment(value: Column, factor: float | Column) -> Column:
    return value * factor + value * (1 - value) * (1 - factor)


def noise(value: Column, kind: str, amount: float, seed: int) -> Column:
    """Gaussian or speckle noise of a variance, or salt and pepper of a share of voxels."""
    if kind == "gaussian":
        return value + F.randn(seed) * amount**0.5
    if kind == "speckle":
        return value + value * F.randn(seed) * amount**0.5
    if kind == "salt_pepper":
        r = F.rand(seed)
        return F.when(r < amount / 2, 0.0).when(r < amount, 1.0).otherwise(value)
    raise ValueError(f"unknown noise {kind}")


def combine_channels(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.withColumnRenamed("value", "_1").join(two.withColumnRenamed("value", "_2"), ["t", *SPACE]).select("t", *SPACE, F.array("_1", "_2").alias("value"))


def shuffle_channels(value: Column, seed: int) -> Column:
    return F.shuffle(value, seed)


def stack(draws: list[DataFrame]) -> DataFrame:
    out = None
    for k, d in enumerate(draws):
        d = d.withColumn("rep", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


# ---- points --------------------------------------------------------------


def zoom_points(nodes: DataFrame, centre: tuple, factor: float) -> DataFrame:
    return nodes.select("id", "t", *[(F.lit(float(c)) + (F.col(d) - float(c)) * float(factor)).alias(d) for d, c in zip(SPACE, centre)])


def rotate_scale_points(nodes: DataFrame, centre: tuple, angle_cos: float, angle_sin: float, scale: tuple) -> DataFrame:
    """The affine part of an elastic change: rotation in the plane of y and x about the centre, and scaling."""
    y, x = F.col("y") - float(centre[1]), F.col("x") - float(centre[2])
    z = (F.col("z") - float(centre[0])) * float(scale[0]) + float(centre[0])
    return nodes.select("id", "t", z.alias("z"), ((y * angle_cos - x * angle_sin) * float(scale[1]) + float(centre[1])).alias("y"), ((y * angle_sin + x * angle_cos) * float(scale[2]) + float(centre[2])).alias("x"))


def shift_points(nodes: DataFrame, shifts: dict[int, tuple], roi=None) -> DataFrame:
    """Points moved by their frame's (z, y, x) shift, then kept if inside the box."""
    out = nodes
    for k, d in enumerate(SPACE):
        move = F.lit(0.0)
        for frame, shift in sorted(shifts.items()):
            move = F.when(F.col("t") == frame, F.lit(float(shift[k]))).otherwise(move)
        out = out.withColumn(d, F.col(d) + move)
    return out if roi is None else out.filter(roi.contains())


def shift_voxels(voxels: DataFrame, shifts: dict[int, tuple]) -> DataFrame:
    """Voxels (t, z, y, x, ...) moved by their frame's whole (z, y, x) shift; what leaves or enters the volume is up to a filter."""
    out = voxels
    for k, d in enumerate(SPACE):
        move = F.lit(0)
        for frame, shift in sorted(shifts.items()):
            move = F.when(F.col("t") == frame, F.lit(int(shift[k]))).otherwise(move)
        out = out.withColumn(d, (F.col(d) + move).cast("bigint"))
    return out


def zoom_voxels(voxels: DataFrame, centre: tuple, factor: float) -> DataFrame:
    """(t, z, y, x, value): the volume zoomed about the centre, at the same voxels, linear between the eight around each source place; outside counts as 0."""
    whole = voxels.select("t", *[F.col(d).cast("bigint").alias(d) for d in SPACE], F.col("value").cast("double").alias("value"))
    asked = whole.select("t", *[F.col(d).alias("o_" + d) for d in SPACE], *[(F.lit(float(c)) + (F.col(d) - float(c)) / float(factor)).alias("q_" + d) for d, c in zip(SPACE, centre)])
    corners = asked.withColumn("w", F.lit(1.0))
    for d in SPACE:
        low = F.floor("q_" + d)
        ends = F.array(F.struct(low.alias("at"), (1 - (F.col("q_" + d) - low)).alias("part")), F.struct((low + 1).alias("at"), (F.col("q_" + d) - low).alias("part")))
        corners = corners.withColumn("_e", F.explode(ends)).withColumn(d, F.col("_e.at")).withColumn("w", F.col("w") * F.col("_e.part")).drop("_e")
    found = corners.filter("w > 0").join(whole, ["t", *SPACE], "left")
    return found.groupBy("t", *["o_" + d for d in SPACE]).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value")).withColumnsRenamed({"o_" + d: d for d in SPACE})


def shift_table(rng, slip: float, shift: float, sigma: float, frames: int = 7) -> dict[int, tuple]:
    """Shifts of the seven frames: the centre frame slips alone, or it and all later ones move; counted from the centre frame, which stays."""
    centre = frames // 2
    move = tuple(round(rng.gauss(0.0, sigma)) for _ in SPACE)
    u = rng.random()
    kind = "slip" if u < slip else "shift" if u < slip + shift else None
    raw = {t: move if kind == "slip" and t == centre or kind == "shift" and t >= centre else (0, 0, 0) for t in range(frames)}
    return {t: tuple(a - b for a, b in zip(v, raw[centre])) for t, v in raw.items()}


def training_metrics(rows: DataFrame) -> DataFrame:
    """One row of rates and losses from rows with indicator, predicted and true motion, and weights."""
    dot = sum((F.col("p_" + d) * F.col("mv_" + d) for d in ("y", "x")), F.col("p_z") * F.col("mv_z"))
    norm = lambda p: F.sqrt(sum((F.col(p + d) * F.col(p + d) for d in ("y", "x")), F.col(p + "z") * F.col(p + "z")))
    error = F.sqrt(distance2("p_", "mv_"))
    cosine = F.when((norm("p_") == 0) | (norm("mv_") == 0), F.lit(0.0)).otherwise(dot / F.nullif(norm("p_") * norm("mv_"), F.lit(0.0)))
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    difference = F.col("indicator") - F.col("truth")
    return rows.agg(
        rate(F.col("indicator") > 0.5).alias("indicator_rate"), rate(cosine > 0.9).alias("cosine_rate"), F.avg(error).alias("mean_error"), rate(error < 1.0).alias("close_rate"),
        (F.sum(F.col("weight") * difference * difference) / F.greatest(F.sum("weight"), F.lit(1e-4))).alias("weighted_mse"),
    )


def mean_squared_error(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """The loss without weights."""
    return rows.agg(F.avg((F.col(predicted) - F.col(truth)) * (F.col(predicted) - F.col(truth))).alias("mse"))


def loss_blend(step: Column, factor: float, offset: float) -> Column:
    return 1.0 / (1.0 + F.exp(factor * (offset - step)))


def provider(step: Column, n: int) -> Column:
    return F.when(step % n == 1, "val").otherwise("train")


def centre_crop(shape: tuple[int, ...], target: tuple[int, ...]) -> list[tuple[int, int]]:
    """Begin and end of the centred target in each dimension."""
    return [((s - t) // 2, (s - t) // 2 + t) for s, t in zip(shape, target)]


def crop_to_factor(size: int, factor: int, conv_crop: int) -> int:
    """The largest size not above ``size`` that leaves a multiple of ``factor`` after the convolutions."""
    return (size - conv_crop) // factor * factor + conv_crop
