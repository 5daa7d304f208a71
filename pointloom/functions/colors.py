"""Colours and short texts for views of a scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import MASK

# Height ramp, label palette, colours of ground, dimmed ground, small pieces and everything else.
RAMP = [(38, 70, 140), (40, 150, 190), (120, 205, 150), (245, 215, 100), (255, 250, 235)]
PALETTE = [
    (255, 107, 107), (255, 180, 84), (250, 232, 96), (126, 231, 135), (91, 192, 255), (176, 132, 255),
    (255, 138, 208), (64, 224, 208), (255, 153, 102), (173, 255, 47), (135, 176, 255), (255, 99, 172),
]
GROUND, GROUND_DIM, SMALL, OFF_GROUND = (52, 96, 150), (30, 44, 62), (92, 104, 120), (255, 180, 84)
STAGES = ("raw", "voxel", "ground", "object")


def _rgb(c: tuple) -> Column:
    return F.array(*[F.lit(float(v)) for v in c])


def height_color(z: Column) -> Column:
    """Colour of a height: linear between the stops of the ramp, from 2.2 below the sensor over 3.4 metres."""
    z = z.cast("double")
    t = F.least(F.lit(0.9999), F.greatest(F.lit(0.0), (z + 2.2) / 3.4)) * (len(RAMP) - 1)
    i = F.floor(t).cast("int")
    stops = F.array(*[_rgb(c) for c in RAMP])
    low, high = F.get(stops, i), F.get(stops, i + 1)
    return F.zip_with(low, high, lambda a, b: a + (b - a) * (t - i))


def label_color(label: Column) -> Column:
    """Palette colour of a component: multiplicative hash, kept unsigned."""
    h = (label.cast("long") * F.lit(2654435761)).bitwiseAND(F.lit(MASK))
    h = h.bitwiseXOR(F.shiftright(h, 15))
    return F.get(F.array(*[_rgb(c) for c in PALETTE]), (h % len(PALETTE)).cast("int"))


def colorize(stage: Column, z: Column, label: Column) -> Column:
    ground = F.when(label == -2, _rgb(GROUND)).otherwise(_rgb(OFF_GROUND))
    thing = F.when(label == -2, _rgb(GROUND_DIM)).when(label == -1, _rgb(SMALL)).otherwise(label_color(label))
    return F.when(stage.isin("raw", "voxel"), height_color(z)).when(stage == "ground", ground).otherwise(thing)


def tour_stage(frame: Column) -> Column:
    """Stage shown for a frame: twelve frames go through all four."""
    k = F.pmod(frame, F.lit(12))
    return F.when(k < 2, "raw").when(k < 4, "voxel").when(k < 6, "ground").otherwise("object")


def budget_pct(total_ms: Column, hz: float = 10.0) -> Column:
    return total_ms / (1000.0 / hz) * 100.0


def milliseconds(v: Column) -> Column:
    return F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v)), F.lit("ms"))


def describe(stage: Column, stats: Column, ms: Column) -> Column:
    """One line about a stage of a scan; stats and ms are structs."""
    n = lambda c: F.format_number(c, 0)
    return (
        F.when(stage == "raw", F.concat(n(stats["points"]), F.lit(" points")))
        .when(stage == "voxel", F.concat(n(stats["points"]), F.lit(" to "), n(stats["voxels"]), F.lit(" voxels ("), F.format_string("%.1f", stats["points"] / stats["voxels"]), F.lit(" times fewer), "), milliseconds(ms["voxel"])))
        .when(stage == "ground", F.concat(n(stats["ground"]), F.lit(" ground voxels from "), n(stats["iters"]), F.lit(" planes, "), milliseconds(ms["ransac"])))
        .otherwise(F.concat(n(stats["clusters"]), F.lit(" objects, "), n(stats["small"]), F.lit(" small pieces, "), milliseconds(ms["cluster"])))
    )
