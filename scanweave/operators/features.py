"""Shape features of point groups: second moments, eigen features, variance along the radius, shape histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.geometry import eigenvalues3, polar_angle

MOMENTS = ("xx", "xy", "xz", "yy", "yz", "zz")
EIGEN = ("linearity", "planarity", "scattering", "omnivariance", "anisotropy", "eigen_entropy", "change_of_curvature")


def moments(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, mean_x..mean_z, xx..zz): means and population covariances, merged from partial ones of each task."""
    pairs = [(m, F.covar_pop(m[0], m[1])) for m in MOMENTS]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in "xyz"), *(f.alias(m) for m, f in pairs))


def eigen_features(spread: DataFrame) -> DataFrame:
    """Adds the eigenvalues e1 >= e2 >= e3 of the moments, and seven features of their shares of the sum.

    A group without spread (one point, or equal ones) has null features. An eigenvalue of zero adds nothing to the entropy,
    and what rounding leaves of one (below 1e-12 of the sum) is zero. The entropy is that of all three shares.
    """
    out = eigenvalues3(spread)
    total = F.col("e1") + F.col("e2") + F.col("e3")
    out = out.withColumn("__sum", F.when(total > 0, total))
    share = lambda e: F.when(F.col(e) > 1e-12 * F.col("__sum"), F.col(e) / F.col("__sum")).otherwise(F.when(F.col("__sum").isNotNull(), 0.0))
    out = out.withColumns({f"__{k}": share(f"e{k}") for k in (1, 2, 3)})
    a, b, c = (F.col(f"__{k}") for k in (1, 2, 3))
    log = lambda v: F.when(v > 0, v * F.ln(v)).otherwise(v)
    found = (F.abs((a - b) / a), F.abs((b - c) / a), F.abs(c / a), F.pow(a * b * c, F.lit(1 / 3)), F.abs((a - c) / a), F.abs(log(a) + log(b) + log(c)), F.abs(c / (a + b + c)))
    return out.withColumns(dict(zip(EIGEN, found))).drop("__sum", "__1", "__2", "__3")


def principal_variance(spread: DataFrame) -> DataFrame:
    """Adds radial_var and tangent_var, the variances along the direction from the origin to the mean and across it in the
    plane, and principal_var, the larger of them. The aggregate is turned, not the points."""
    turn = F.atan2(F.col("mean_y"), F.col("mean_x"))
    out = spread.withColumns({"__c": F.cos(turn), "__s": F.sin(turn)})
    c, s, mixed = F.col("__c"), F.col("__s"), 2 * F.col("__c") * F.col("__s") * F.col("xy")
    out = out.withColumns({"radial_var": c * c * F.col("xx") + s * s * F.col("yy") + mixed, "tangent_var": s * s * F.col("xx") + c * c * F.col("yy") - mixed})
    return out.withColumn("principal_var", F.greatest("radial_var", "tangent_var")).drop("__c", "__s")


def descriptor(boxes: DataFrame, s: Settings) -> Column:
    """Eleven values of a box with eigen features: six of these over their maxima, height, area, turn, base and type."""
    limits = (s.k_linearity_max, s.k_planarity_max, s.k_scattering_max, s.k_omnivariance_max, s.k_anisotropy_max, s.k_eigen_entropy_max)
    turn = F.abs(polar_angle(F.col("max_x"), F.col("max_y")) - polar_angle(F.col("min_x"), F.col("min_y")))
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    kind = F.coalesce(F.col("type").cast("double"), F.lit(-1.0)) if "type" in boxes.columns else F.lit(-1.0)
    return F.array(*(F.coalesce(F.col(f) / limit, F.lit(1.0)) for f, limit in zip(EIGEN, limits)), F.col("max_z"), area, turn, F.col("min_z"), kind)


# ---- shape histograms of sampled triples

#: Bins of one histogram, and the fold of all of them.
BINS, FOLD = 64, 10
HISTOGRAMS = ("d_in", "d_out", "d_mixed", "d_ratio", "s_in", "s_out", "s_mixed", "a_in", "a_out", "a_mixed")
#: Cells of the cube about a group, an axis, and places probed on a line between two points.
CELLS, PROBES = 64, 8
# fixed values: a multiplicative generator modulo a prime
_PRIME, _STEP, _LEAP = 2147483647, 48271, 69621


def _draw(seed: int, triple: Column, corner: int, group: Column) -> Column:
    """A number below the prime for each (seed, group, triple, corner), the same in every plan and engine."""
    first = F.pmod(triple * 7919 + corner * 104729 + F.pmod(group, F.lit(_PRIME)) * 31 + seed * 127 + 1, F.lit(_PRIME))
    return F.pmod(F.pmod(F.pmod(first * _STEP, F.lit(_PRIME)) * _LEAP + corner, F.lit(_PRIME)) * _STEP, F.lit(_PRIME))


def shape_histograms(points: DataFrame, keys: list[str], group: Column, triples: int = 200, seed: int = 1) -> DataFrame:
    """(keys, histogram): 640 shares, ten histograms of 64 bins, from sampled triples of each group's points.

    points: keys and x, y, z; `group`, a long of the keys, goes into the draw. Points are numbered by x, y, z; every group
    has `triples` triples, drawn with replacement from (seed, group, triple), so that rows are the same however the input is
    parted. A line between two points is in, out or mixed by what share of eight places on it lies in occupied cells of a
    grid of 64^3 about the group. Distances and roots of areas are parts of that cube's diagonal, and angles of half a turn,
    all in 64 bins; mixed lines also have their shares. Each of the four kinds sums up to one where it has samples. A group's
    points are numbered by its size in one sort; a task's group is one cluster.
    """
    from pyspark.sql import Window

    boxes = points.groupBy(*keys).agg(F.count("*").cast("long").alias("n"), *(F.min(c).alias(f"low_{c}") for c in "xyz"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("side"))
    side = F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)
    cell = lambda c, at: F.least(F.floor((at - F.col(f"low_{c}")) / side * CELLS), F.lit(CELLS - 1)).cast("int")
    numbered = points.select(*keys, "x", "y", "z").withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "y", "z")) - 1)
    occupied = points.join(boxes, keys).select(*keys, *(cell(c, F.col(c)).alias(f"c{c}") for c in "xyz")).distinct().withColumn("full", F.lit(1.0))
    draws = boxes.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(triples - 1).cast("long"))))
    corners = F.array(*(F.struct(F.lit(k).alias("corner"), F.pmod(_draw(seed, F.col("t"), k, group), F.col("n")).alias("i")) for k in range(3)))
    drawn = draws.select(*keys, "t", F.explode(corners).alias("d")).select(*keys, "t", "d.corner", F.col("d.i").cast("int").alias("i"))
    placed = drawn.join(numbered, [*keys, "i"]).groupBy(*keys, "t").agg(*(F.max(F.when(F.col("corner") == k, F.struct("x", "y", "z"))).alias(f"p{k}") for k in range(3)))
    at = lambda k, c: F.col(f"p{k}.{c}")
    far = lambda a, b: F.sqrt(sum(((at(a, c) - at(b, c)) * (at(a, c) - at(b, c)) for c in "yz"), (at(a, "x") - at(b, "x")) * (at(a, "x") - at(b, "x"))))
    lines = F.array(*(F.struct(F.lit(k).alias("line"), F.col(f"p{a}").alias("a"), F.col(f"p{b}").alias("b"), far(a, b).alias("d")) for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))))
    lined = placed.select(*keys, "t", "p0", "p1", "p2", F.explode(lines).alias("l"))
    probes = lined.join(boxes, keys).withColumn("f", F.explode(F.array(*(F.lit((k + 1) / (PROBES + 1)) for k in range(PROBES)))))
    on = lambda c: F.col(f"l.a.{c}") + (F.col(f"l.b.{c}") - F.col(f"l.a.{c}")) * F.col("f")
    hit = probes.select(*keys, "t", "p0", "p1", "p2", F.col("l.line").alias("line"), F.col("l.d").alias("d"), "side", *(cell(c, on(c)).alias(f"c{c}") for c in "xyz")).join(occupied, [*keys, "cx", "cy", "cz"], "left")
    per_line = hit.groupBy(*keys, "t", "line").agg(F.sum(F.coalesce("full", F.lit(0.0))).cast("int").alias("hits"), F.first("d").alias("d"), F.first("side").alias("side"), *(F.first(p).alias(p) for p in ("p0", "p1", "p2")))
    per_triple = per_line.groupBy(*keys, "t").agg(F.collect_list(F.struct("line", "d", "hits")).alias("ls"), F.first("side").alias("side"), *(F.first(p).alias(p) for p in ("p0", "p1", "p2")))
    ls = F.array_sort("ls")
    d = [F.element_at(ls, k + 1)["d"] for k in range(3)]
    hits = [F.element_at(ls, k + 1)["hits"] for k in range(3)]
    kind = lambda h: F.when(h == PROBES, 0).when(h == 0, 1).otherwise(2)
    half = (d[0] + d[1] + d[2]) / 2
    area = F.sqrt(F.greatest(F.lit(0.0), half * (half - d[0]) * (half - d[1]) * (half - d[2])))
    # the angle at p0, between lines 0 and 1; line 2 lies across it
    cosine = F.when((d[0] > 0) & (d[1] > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (d[0] * d[0] + d[1] * d[1] - d[2] * d[2]) / (2 * d[0] * d[1]))))
    diagonal = F.when(F.col("side") > 0, F.col("side")).otherwise(1.0) * 3**0.5
    bin_of = lambda v: F.least(F.floor(v * BINS), F.lit(BINS - 1)).cast("int")
    entry = lambda h, v: F.struct(h.cast("int").alias("h"), bin_of(v).alias("b"))
    # a triangle is in if all its lines are, out if none has an occupied place
    whole = kind(F.when((hits[0] == PROBES) & (hits[1] == PROBES) & (hits[2] == PROBES), PROBES).when(hits[0] + hits[1] + hits[2] == 0, 0).otherwise(1))
    entries = F.array(*(entry(kind(h), v / diagonal) for h, v in zip(hits, d)), *(F.when(kind(h) == 2, entry(F.lit(3), h / PROBES)) for h in hits), entry(4 + whole, F.sqrt(area) / diagonal), F.when(cosine.isNotNull(), entry(7 + kind(hits[2]), F.acos(cosine) / 3.141592653589793)))
    counted = per_triple.select(*keys, F.explode(F.array_compact(entries)).alias("e")).groupBy(*keys, "e.h", "e.b").agg(F.count("*").alias("k"))
    sort = F.when(F.col("h") < 3, 0).when(F.col("h") == 3, 1).when(F.col("h") < 7, 2).otherwise(3)
    per_sort = counted.withColumn("sort", sort).groupBy(*keys, "sort").agg(F.sum("k").alias("all"), F.collect_list(F.struct("h", "b", "k")).alias("bins"))
    shares = per_sort.select(*keys, F.explode(F.transform("bins", lambda x: F.struct((x["h"] * BINS + x["b"]).alias("i"), (x["k"] / F.col("all")).alias("v")))).alias("s"))
    maps = shares.groupBy(*keys).agg(F.map_from_entries(F.collect_list("s")).alias("m"))
    return maps.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(len(HISTOGRAMS) * BINS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("histogram"))


def folded(histogram: Column) -> Column:
    """The 640 shares summed up to ten by their place modulo ten."""
    places = F.transform(F.sequence(F.lit(0), F.lit(FOLD - 1)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(len(HISTOGRAMS) * BINS // FOLD - 1)), F.lit(0.0), lambda total, k: total + F.element_at(histogram, k * FOLD + j + 1)))
    return places


def joint(eigen: Column, shape: Column) -> Column:
    """The eleven values of a descriptor and the ten of a folded histogram in one array of 21."""
    return F.concat(eigen, shape)
