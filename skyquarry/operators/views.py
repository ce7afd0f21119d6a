"""What an observer sees of an elevation grid, ring by ring around them: work in proportion to the cells.

A cell's line of sight crosses the ring before its own between two cells: the one
straight behind it and the one diagonally behind.  What those two hide is
interpolated there and carried outwards; the cell is seen if it rises to it, and
hides the higher of both from those behind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.engine.tables import fresh_path, removed, written

#: Height that hides nothing.
FREE = -1e300
#: Rounding of an interpolated height: a cell that lies on the line of sight is seen.
SLACK = 1e-9


def _rings(first: int, band: int, segment: int):
    """A band of rings of one octant's segment; rows of the ring before it hold what is hidden there, and come along unchanged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, start = int(pdf["s"].iloc[0]), int(pdf["s"].iloc[0]) * segment
        low = max(0, start - band)  # what a band's cells read lies no further back
        width = min(start + segment, int(pdf["t"].max()) + 1) - low
        last = int(pdf["r"].max())
        r, t = pdf["r"].to_numpy(), pdf["t"].to_numpy() - low
        rise = np.full((last - first + 2, width), np.nan)
        rise[r - first + 1, t] = pdf["rise"].to_numpy(float)
        hides, line = np.full(rise.shape, FREE), np.full(rise.shape, FREE)
        hides[0] = np.where(np.isnan(rise[0]), FREE, rise[0])
        at = np.arange(width) + low
        for k in range(1, len(rise)):
            ring = first + k - 1
            if ring > 1:
                straight, diagonal = hides[k - 1], np.concatenate([[FREE], hides[k - 1][:-1]])
                near = np.where(at == 0, straight * ring, np.where(at >= ring, diagonal * ring, diagonal * at + straight * (ring - at)))
                line[k] = np.maximum(near / (ring - 1), FREE)
            hides[k] = np.fmax(rise[k], line[k])
        own = (r >= first) & (pdf["t"].to_numpy() >= start) & pdf["own"].to_numpy()
        k, c = r[own] - first + 1, t[own]
        return pd.DataFrame({"x": pdf["x"].to_numpy()[own], "y": pdf["y"].to_numpy()[own], "r": r[own], "rise": hides[k, c], "visible": np.where(np.isnan(rise[k, c]), -1, np.where(rise[k, c] >= line[k, c] - SLACK, 255, 0))})

    assert segment >= band
    return run


def _bands(steps: list[tuple[int, int]], band: int, most: int) -> list[tuple[int, int, int]]:
    """(first step, last step, widest t) of the bands that ``steps`` (number, widest t) of ``band`` rings make: as many rings as ``most`` cells of an octant hold, one step at least."""
    out: list[tuple[int, int, int]] = []
    for step, wide in steps:
        first, _, widest = out[-1] if out else (step, step, wide)
        if out and (step + 1 - first) * band * (max(wide, widest) + 1) <= most:
            out[-1] = (first, step, max(wide, widest))
        else:
            out.append((step, step, wide))
    return out


def viewshed(dem: DataFrame, ox: int, oy: int, height: float = 1.7, radius: int | None = None, band: int = 256, segment: int = 1024, most: int = 1 << 20) -> DataFrame:
    """(x, y, visible 255 or 0) of all cells with a value, or of those within a radius of an observer ``height`` above their cell.

    Heights that hide are interpolated between the two cells of the ring before that a
    line of sight passes; a missing cell hides nothing and passes on what is hidden
    behind it.  Nothing is seen from a missing cell (no rows).  A cell occurs once.

    The grid is read in bands of rings: each is one job, whose tasks are segments of
    an octant, with a margin of ``band`` cells towards the axis; it reads the last
    ring of the band before.  Where the grid is so narrow that an octant of several
    bands has ``most`` cells at most, these are one band, so jobs are as many as the
    cells need, not as the rings.  Bands and margins are bounded, whatever the grid's size.
    """
    spark, (ox, oy) = dem.sparkSession, (int(ox), int(oy))
    eye = dem.where((F.col("x") == ox) & (F.col("y") == oy) & F.col("z").isNotNull()).agg(F.max("z").alias("z")).first()["z"]
    result = "x bigint, y bigint, visible int"
    if eye is None:
        return spark.createDataFrame([], result)
    eye = float(eye) + float(height)
    dx, dy = F.col("x") - ox, F.col("y") - oy
    cells = dem.where(F.col("z").isNull() | ~F.isnan("z")).select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), (F.col("z") - F.lit(eye)).alias("rise"))
    if radius is not None:
        cells = cells.where(F.col("x").between(ox - radius, ox + radius) & F.col("y").between(oy - radius, oy + radius) & (dx * dx + dy * dy <= radius * radius))
    cells = cells.withColumn("r", F.greatest(F.abs(dx), F.abs(dy)).cast("bigint"))
    cells = cells.withColumn("t", F.least(F.abs(dx), F.abs(dy)).cast("bigint")).withColumn("step", F.floor((F.greatest(F.col("r"), F.lit(1)) - 1) / band))
    steps = cells.groupBy("step").agg(F.max("t").alias("t")).orderBy("step").collect()  # as many as bands of rings
    bands = _bands([(s["step"], s["t"]) for s in steps], band, most)
    base = fresh_path(spark)
    edges = spark.createDataFrame([(k, first, last) for k, (first, last, _) in enumerate(bands)], "band int, first bigint, last bigint")
    written(cells.join(F.broadcast(edges), F.col("step").between(F.col("first"), F.col("last"))).select("x", "y", "rise", "r", "band"), f"{base}/cells", by=("band",))
    cells = spark.read.schema("x bigint, y bigint, rise double, r bigint, band int").parquet(f"{base}/cells")
    row = "x bigint, y bigint, r bigint, rise double, visible int"
    for k, (start, stop, wide) in enumerate(bands):
        first, rings = start * band + 1, (stop + 1 - start) * band
        part = max(segment, rings)
        ring = cells.where(F.col("band") == k).where("r > 0").drop("band")
        before = spark.read.schema(row).parquet(f"{base}/seen/band={k - 1}").where(F.col("r") == first - 1).drop("visible") if k else cells.where("band = 0 and r = 0").drop("band")
        rows = before.select("x", "y", "rise", "r").unionByName(ring.select("x", "y", "rise", "r"))
        # octants: which axis is longer, and both signs; cells on an axis or a diagonal lie in several
        signs = lambda d: F.when(d == 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.signum(d).cast("int")))
        axes = F.when(F.abs(dx) == F.abs(dy), F.array(F.lit(0), F.lit(1))).when(F.abs(dx) > F.abs(dy), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
        rows = rows.withColumn("t", F.least(F.abs(dx), F.abs(dy)).cast("bigint")).withColumn("axis", F.explode(axes)).withColumn("sx", F.explode(signs(dx))).withColumn("sy", F.explode(signs(dy)))
        own = (F.col("axis") == F.element_at(axes, 1)) & (F.col("sx") == F.element_at(signs(dx), 1)) & (F.col("sy") == F.element_at(signs(dy), 1))
        segments = F.sequence(F.floor(F.col("t") / part), F.least(F.floor((F.col("t") + rings) / part), F.floor(F.greatest(F.lit(wide), F.col("t")) / part)))
        rows = rows.withColumn("own", own).withColumn("s", F.explode(segments))
        seen = rows.groupBy("axis", "sx", "sy", "s").applyInPandas(_rings(first, rings, part), row)
        written(seen, f"{base}/seen/band={k}")
    own = spark.createDataFrame([(ox, oy, 255)], result)
    removed(spark, f"{base}/cells")
    return spark.read.schema(row).parquet(*(f"{base}/seen/band={k}" for k in range(len(bands)))).where("visible >= 0").select("x", "y", "visible").union(own)
