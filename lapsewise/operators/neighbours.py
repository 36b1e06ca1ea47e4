"""Density clustering on a grid: noise, core points and clusters without comparing all pairs.

Cells have diagonal eps, so points sharing a cell are neighbours. A cell holding `min_samples`
points makes all of them core without measuring anything. Distances are measured only from
points of light cells (fewer than `min_samples` points each) to the 125 cells around them, so
the number of measured pairs grows linearly with the points, also when one cell holds a large
share of them. Equal points are collapsed to one weighted point first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapsewise.session import GROUP_ROWS, materialise, setting

CELL = ["_cx", "_cy", "_cz"]


def _weighted(points: DataFrame, features: Sequence[str]) -> DataFrame:
    return points.groupBy(*[F.col(c).cast("double").alias(f"_{a}") for c, a in zip(features, "xyz")]).agg(
        F.count(F.lit(1)).alias("_w")
    )


def _celled(points: DataFrame, side: float) -> DataFrame:
    return points.withColumns({f"_c{a}": F.floor(F.col(f"_{a}") / side) for a in "xyz"})


def _around(cells: DataFrame, reach: int) -> DataFrame:
    """Each cell with the cells up to `reach` steps away, as (_cx.. , _nx..)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumn(
        "_dz", F.explode(steps)
    )
    return spread.withColumns({f"_n{a}": F.col(f"_c{a}") + F.col(f"_d{a}") for a in "xyz"}).drop("_dx", "_dy", "_dz")


def _squared(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz"), F.lit(0.0))


def _point(prefix: str = "_") -> Column:
    return F.struct(*[F.col(f"{prefix}{a}").alias(a) for a in "xyz"])


def core_points(points: DataFrame, eps: float, min_samples: int, features: Sequence[str]) -> DataFrame:
    """Distinct points with `core` and `noise` flags (0/1), weights and cells."""
    if len(features) != 3:
        raise ValueError("the grid is laid out for three features")
    # A hair below eps / sqrt(3) keeps rounding from placing two points of a cell beyond eps.
    side = eps / 3 ** 0.5 * (1 - 1e-9)
    celled = _celled(_weighted(points, features), side)
    cells = celled.groupBy(*CELL).agg(F.sum("_w").alias("_cell_w"), F.count(F.lit(1)).alias("_cell_rows"))
    marked = materialise(celled.join(cells, CELL).withColumn("_dense", F.col("_cell_w") >= min_samples))

    light = marked.filter(~F.col("_dense")).select(*CELL, _point().alias("p"))
    light_cells = light.select(*CELL).distinct()
    # Split the points of very full cells over several join keys; such cells are few by definition.
    limit = setting(points.sparkSession, GROUP_ROWS)
    full = F.broadcast(
        cells.filter(F.col("_cell_rows") > limit).select(*CELL, F.ceil(F.col("_cell_rows") / limit).alias("_parts"))
    )
    targets = marked.join(full, CELL, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64("_x", "_y", "_z"), F.col("_parts")), F.lit(0))
    ).select(*[F.col(c).alias(c.replace("_c", "_n")) for c in CELL], "_part", _point().alias("q"), "_w", "_dense")
    named = full.select(*[F.col(c).alias(c.replace("_c", "_n")) for c in CELL], "_parts")
    pairs = _around(light_cells, 2).join(named, ["_nx", "_ny", "_nz"], "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    ).drop("_parts")
    occupied = pairs.join(
        cells.select(*[F.col(c).alias(c.replace("_c", "_n")) for c in CELL]), ["_nx", "_ny", "_nz"], "left_semi"
    )
    near = (
        light.join(occupied, CELL)
        .join(targets, ["_nx", "_ny", "_nz", "_part"])
        .filter(_squared("p", "q") <= eps * eps)
    )
    counted = materialise(near.groupBy("p").agg(
        F.sum("_w").alias("_neighbours"), F.max("_dense").alias("_touches_dense")
    ).withColumn("_core", F.col("_neighbours") >= min_samples))

    # Points still undecided can only be saved by a core point of another light cell.
    def with_cells(df: DataFrame, name: str) -> DataFrame:
        flat = df.select(F.col("p").alias(name), *[F.col(f"p.{a}").alias(f"_{a}") for a in "xyz"])
        return _celled(flat, side).drop("_x", "_y", "_z")

    open_points = with_cells(counted.filter(~F.col("_core") & ~F.col("_touches_dense")), "p")
    light_core = with_cells(counted.filter("_core"), "q").select(
        *[F.col(c).alias(c.replace("_c", "_n")) for c in CELL], "q"
    )
    saved = (
        _around(open_points, 2).join(light_core, ["_nx", "_ny", "_nz"])
        .filter(_squared("p", "q") <= eps * eps).select("p").distinct()
    )
    noise = open_points.select("p").join(saved, "p", "left_anti").withColumn("_noise", F.lit(True))
    flags = counted.select("p", "_core").join(noise, "p", "left")
    return marked.withColumn("p", _point()).join(flags, "p", "left").select(
        "_x", "_y", "_z", "_w", *CELL, "_dense",
        F.coalesce("_core", "_dense").cast("int").alias("core"),
        F.coalesce("_noise", F.lit(False)).cast("int").alias("noise"),
    )


def _flag_rows(points: DataFrame, flagged: DataFrame, features: Sequence[str], columns: Sequence[str]) -> DataFrame:
    keyed = points.withColumns({f"_{a}": F.col(c).cast("double") for c, a in zip(features, "xyz")})
    return keyed.join(flagged.select("_x", "_y", "_z", *columns), ["_x", "_y", "_z"]).drop("_x", "_y", "_z")


def dbscan_noise(points: DataFrame, eps: float, min_samples: int, features: Sequence[str]) -> DataFrame:
    """The input rows with `core` and `noise` flags."""
    return _flag_rows(points, core_points(points, eps, min_samples, features), features, ["core", "noise"])


def robust_outliers(
    points: DataFrame, eps_values: Sequence[float], min_samples: int, features: Sequence[str]
) -> DataFrame:
    """Keys that are noise at every eps.

    Growing eps only adds neighbours and core points, so noise at the largest eps is noise at
    every smaller one: one run decides.
    """
    if not eps_values:
        raise ValueError("eps_values cannot be empty")
    flagged = dbscan_noise(points, max(eps_values), min_samples, features)
    return flagged.filter("noise = 1").select("customer_id")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node: neighbours' minimum, then the label's own label, until stable.

    Nodes are grid cells, so the graph is bounded by the occupied volume, not by the rows.
    """
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(nodes.select("node", F.col("node").alias("label")))
    while True:
        offered = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(
            F.min("label").alias("_offer")
        )
        lowered = labels.join(offered, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", "_offer").alias("label")
        )
        jump = lowered.select(F.col("node").alias("label"), F.col("label").alias("_jump"))
        stepped = materialise(
            lowered.join(jump, "label", "left").select("node", "_old", F.least("label", "_jump").alias("label"))
        )
        changed = stepped.filter("label <> _old").limit(1).count()
        labels = stepped.drop("_old")
        if not changed:
            return labels


def dbscan_clusters(points: DataFrame, eps: float, min_samples: int, features: Sequence[str]) -> DataFrame:
    """The input rows with a `cluster` struct (null for noise): the first cell of the cluster.

    All core points of a cell belong together, so clusters are components of cells. Two cells are
    linked when two of their core points are within eps. The outermost core points of neighbouring cells settle
    most links; what else could be linked matters only between cells that these leave in different
    clusters: there quarter-cells that lie close as a whole count, and points are compared for cell pairs the
    quarters leave open. A border point within reach of several clusters joins the smallest; where
    all cells around have one cluster, nothing is measured.
    """
    side = eps / 3 ** 0.5 * (1 - 1e-9)
    flagged = materialise(core_points(points, eps, min_samples, features))
    node = F.struct(*[F.col(c).alias(c[-1]) for c in CELL])
    parts = 4
    fine = side / parts
    core = flagged.filter("core = 1").withColumns(
        {"node": node} | {f"_f{a}": F.floor(F.col(f"_{a}") / fine) for a in "xyz"}
    )
    outermost = [by(_point(), f"_{a}") for a in "xyz" for by in (F.min_by, F.max_by)]
    nodes = materialise(core.groupBy("node", *CELL).agg(F.array_distinct(F.array(*outermost)).alias("_ends")))
    other = nodes.select(F.col("node").alias("other"), *[F.col(c).alias(c.replace("_c", "_n")) for c in CELL])
    near = _around(nodes.select("node", *CELL), 2).join(other, ["_nx", "_ny", "_nz"]).filter("node < other").select("node", "other")
    ends = nodes.select("node", "_ends")
    apart = lambda p, q: sum(((p[a] - q[a]) * (p[a] - q[a]) for a in "xyz"), F.lit(0.0))
    met_at_ends = F.exists("_ends", lambda p: F.exists("_others", lambda q: apart(p, q) <= eps * eps))
    pairs = materialise(near.join(ends, "node").join(
        ends.select(F.col("node").alias("other"), F.col("_ends").alias("_others")), "other"
    ).select("node", "other", met_at_ends.alias("_met")))
    labels = _components(nodes.select("node"), pairs.filter("_met").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("_label"))
    linked = materialise(pairs.filter("not _met").join(labels, "node").join(of_other, "other").filter("label <> _label").select("node", "other"))

    eighth = core.select("node", F.struct(*[F.col(f"_f{a}").alias(a) for a in "xyz"]).alias("f")).distinct()
    combos = linked.join(eighth, "node").join(
        eighth.select(F.col("node").alias("other"), F.col("f").alias("g")), "other"
    )

    def gap(extra: int) -> Column:
        spans = [F.greatest(F.abs(F.col(f"f.{a}") - F.col(f"g.{a}")) + extra, F.lit(0)) * F.lit(fine) for a in "xyz"]
        return sum((s * s for s in spans), F.lit(0.0))

    # Widest and narrowest possible distance of two points in the pair of small cells.
    rated = combos.withColumns({"_sure": gap(1) <= eps * eps, "_open": gap(-1) <= eps * eps}).filter("_open")
    settled = rated.groupBy("node", "other").agg(F.max("_sure").alias("_sure"))
    sure = settled.filter("_sure").select("node", "other")
    unsure = rated.join(settled.filter(~F.col("_sure")).select("node", "other"), ["node", "other"], "left_semi")
    small = core.select("node", F.struct(*[F.col(f"_f{a}").alias(a) for a in "xyz"]).alias("f"), _point().alias("p"))
    met = (
        unsure.select("node", "other", "f", "g").join(small, ["node", "f"])
        .join(small.select(F.col("node").alias("other"), F.col("f").alias("g"), F.col("p").alias("q")), ["other", "g"])
        .filter(_squared("p", "q") <= eps * eps).select("node", "other").distinct()
    )
    edges = sure.unionByName(met).select(F.col("node").alias("a"), F.col("other").alias("b"))
    # Clusters found so far are the nodes now; the smallest of them names what they form.
    between = edges.join(labels, F.col("a") == F.col("node")).select(F.col("label").alias("a"), "b").join(
        labels, F.col("b") == F.col("node")
    ).select("a", F.col("label").alias("b"))
    whole = _components(labels.select(F.col("label").alias("node")).distinct(), between).withColumnsRenamed({"node": "_part", "label": "cluster"})
    cells = nodes.select("node", *CELL).join(labels, "node").join(whole, F.col("label") == F.col("_part"))
    labels = materialise(cells.select("node", *CELL, F.col("cluster").alias("label")))

    labelled = core.drop(*CELL).join(labels, "node").select("_x", "_y", "_z", *CELL, F.col("label").alias("cluster"))
    # Border points sit in light cells, so each is compared with the core points around it only.
    border = flagged.filter("core = 0 and noise = 0").select(*CELL, _point().alias("p"))
    named = labels.select(*[F.col(c).alias(c.replace("_c", "_n")) for c in CELL], "label")
    homes = materialise(_around(border.select(*CELL).distinct(), 2).join(named, ["_nx", "_ny", "_nz"]).groupBy(*CELL).agg(
        F.min("label").alias("cluster"), F.max("label").alias("_last")
    ))
    joined = border.join(homes.filter("cluster = _last"), CELL).select(*[F.col(f"p.{a}").alias(f"_{a}") for a in "xyz"], "cluster")
    border = border.join(homes.filter("cluster <> _last"), CELL, "left_semi")
    reach = labelled.select(
        *[F.col(c).alias(c.replace("_c", "_n")) for c in CELL], _point().alias("q"), "cluster"
    )
    measured = _around(border, 2).join(reach, ["_nx", "_ny", "_nz"]).filter(_squared("p", "q") <= eps * eps).groupBy(
        "p"
    ).agg(F.min("cluster").alias("cluster")).select(*[F.col(f"p.{a}").alias(f"_{a}") for a in "xyz"], "cluster")
    assigned = labelled.drop(*CELL).unionByName(joined).unionByName(measured)
    keyed = points.withColumns({f"_{a}": F.col(c).cast("double") for c, a in zip(features, "xyz")})
    return keyed.join(assigned, ["_x", "_y", "_z"], "left").drop("_x", "_y", "_z")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Number of clusters, noise rows and their share."""
    per = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0))
    return per.agg(F.count("cluster").alias("clusters"), noise.alias("noise_rows"), (noise / F.sum("n")).alias("noise_share"))


def kth_neighbour_distance(
    points: DataFrame, k: int, features: Sequence[str], levels: int = 16
) -> DataFrame:
    """The input rows with `distance` to the k-th nearest row, counting the row itself.

    Grids of halving cell sides let every point search at its own scale. A cell of side s with k
    points proves the answer is at most s * sqrt(3); the 27 cells of twice that side around the
    point cover this radius, so comparing with them is exact. Points choose the finest grid that
    works: crowded places are searched in small cells, and only few points per cell of any grid
    fall back to it, so pairs grow linearly with the points.
    """
    weighted = materialise(_weighted(points, features))
    facts = weighted.agg(
        F.sum("_w").alias("n"), *[F.min(f"_{a}").alias(f"low_{a}") for a in "xyz"],
        *[F.max(f"_{a}").alias(f"high_{a}") for a in "xyz"],
    ).first()
    if facts.n is None or facts.n < k:
        raise ValueError(f"fewer than {k} points")
    span = max(facts[f"high_{a}"] - facts[f"low_{a}"] for a in "xyz") or 1.0
    top = span * (1 + 1e-9)

    def side(level: Column) -> Column:
        return F.lit(top) / F.pow(F.lit(2.0), level)

    def at_level(df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"_c{a}": F.floor((F.col(f"_{a}") - F.lit(facts[f"low_{a}"])) / side(F.col("_level"))) for a in "xyz"
        })

    key = ["_level", *CELL]
    # Level -1 is twice the whole span: the search grid of points that need the full extent.
    everywhere = materialise(at_level(weighted.withColumn("_level", F.explode(F.sequence(F.lit(-1), F.lit(levels - 1))))))
    crowded = everywhere.groupBy(*key).agg(F.sum("_w").alias("_cell_w"), F.count(F.lit(1)).alias("_cell_rows"))
    enough = crowded.filter(F.col("_cell_w") >= k).filter("_level >= 0").select(*key)
    finest = everywhere.join(enough, key, "left_semi").groupBy("_x", "_y", "_z").agg(F.max("_level").alias("_level"))
    bound = 3 * side(F.col("_level")) * side(F.col("_level")) * (1 + 1e-9)
    queries = at_level(finest.withColumn("_bound", bound).withColumn("_level", F.col("_level") - 1)).select(
        *key, "_bound", _point().alias("p")
    )
    wanted = _around(queries.select(*key).distinct(), 1)
    limit = setting(points.sparkSession, GROUP_ROWS)
    beside = ["_level", "_nx", "_ny", "_nz"]

    def renamed(df: DataFrame, *more: str) -> DataFrame:
        return df.select("_level", *[F.col(c).alias(c.replace("_c", "_n")) for c in CELL], *more)

    parts = crowded.withColumn("_parts", F.ceil(F.col("_cell_rows") / limit))
    pairs = wanted.join(renamed(parts, "_parts"), beside).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    ).drop("_parts")
    # Only very full cells have more than one part; there are at most rows / limit of them per level.
    full = F.broadcast(parts.filter("_parts > 1").select(*key, "_parts"))
    part = F.coalesce(F.pmod(F.xxhash64("_x", "_y", "_z"), F.col("_parts")), F.lit(0))
    targets = renamed(everywhere.join(full, key, "left").withColumn("_part", part).withColumn("q", _point()), "_part", "q", "_w")
    near = queries.join(pairs, key).join(targets, [*beside, "_part"]).withColumn("_d", _squared("p", "q")).filter(
        F.col("_d") <= F.col("_bound")
    )

    def closest(df: DataFrame, *by: str) -> DataFrame:
        """Rows up to the one that completes k, per group."""
        own = W.partitionBy(*by).orderBy("_d", "q").rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn("_before", F.coalesce(F.sum("_w").over(own), F.lit(0))).filter(F.col("_before") < k)

    # Candidates are cut to k within salted shares first, so no task sorts all of a point's neighbours.
    salted = near.select("p", "q", "_w", "_d", F.pmod(F.xxhash64("q"), F.lit(16)).alias("_salt"))
    kept = closest(closest(salted, "p", "_salt").drop("_before"), "p")
    found = kept.groupBy("p").agg(F.sqrt(F.max("_d")).alias("distance"))
    flat = found.select(*[F.col(f"p.{a}").alias(f"_{a}") for a in "xyz"], "distance")
    return _flag_rows(points, flat, features, ["distance"])
