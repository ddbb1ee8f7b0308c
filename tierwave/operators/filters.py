"""Per-block transforms of a signal before it is summarised, for which no built-in expression exists."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def poly_detrend(y: np.ndarray, value: float, mix: float = 1.0, degree: int = 4) -> np.ndarray:
    """Subtracts a fitted polynomial between the block's outer zeros and rescales to y's range; mix: its share in the result."""
    some = np.flatnonzero(y)
    if y.sum() <= 0 or len(some) < degree + 2:
        return y
    a, b = some[0], some[-1] + 1
    part = y[a:b]
    x = np.linspace(-1, 1, len(part))
    mean, std = part.mean(), part.std()
    fit = np.clip(np.polyval(np.polyfit(x, part - std * value, degree), x), 0, mean + 5 * std * (1 - value))
    flat = np.clip(part - fit, 0, fit.max() - fit.min())
    spread = flat.max() - flat.min()
    scaled = part.min() + (flat - flat.min()) * ((part.max() - part.min()) / spread) if spread > 0 else part
    out = y.astype(float).copy()
    out[a:b] = mix * scaled + (1 - mix) * part
    return out


def haar_denoise(y: np.ndarray, value: float) -> np.ndarray:
    """Soft-thresholds the Haar details of a block, at each level by its largest one times (1 + the block's mean) * (1 - value)."""
    if y.sum() <= 0 or len(y) < 2:
        return y
    n = 1 << (len(y) - 1).bit_length()
    low, details = np.pad(y.astype(float), (0, n - len(y)), mode="edge"), []
    while len(low) > 1:
        details.append((low[0::2] - low[1::2]) / np.sqrt(2))
        low = (low[0::2] + low[1::2]) / np.sqrt(2)
    for d in reversed(details):
        cut = (1 + y.mean()) * (1 - value) * max(d.max(), 0)
        d = np.sign(d) * np.maximum(np.abs(d) - cut, 0)
        out = np.empty(2 * len(low))
        out[0::2], out[1::2] = (low + d) / np.sqrt(2), (low - d) / np.sqrt(2)
        low = out
    return low[: len(y)]


@functools.cache
def scaling_filter(name: str) -> np.ndarray:
    """The orthogonal low-pass filter of `haar` or `db<N>` (2 * N taps): the root of the half-band polynomial inside the unit circle."""
    n = 1 if name == "haar" else int(name.removeprefix("db"))
    if not 1 <= n <= 20:
        raise ValueError(f"no wavelet {name}")
    inside = []
    for y in np.roots([math.comb(n - 1 + k, k) for k in range(n)][::-1]):
        z = np.roots([1, 4 * y - 2, 1])  # y = (2 - z - 1 / z) / 4
        inside.append(z[np.argmin(np.abs(z))])
    h = np.real(np.poly([-1] * n + inside))
    return h * np.sqrt(2) / h.sum()


def _split(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half as many averages and details; the ends are mirrored."""
    taps = len(h)
    high = h[::-1] * (-1.0) ** np.arange(taps)
    wide = np.pad(x, taps - 1, mode="symmetric")
    return tuple(np.convolve(wide, f[::-1], mode="valid")[1::2] for f in (h, high))


def _join(low: np.ndarray, detail: np.ndarray, h: np.ndarray) -> np.ndarray:
    taps, out = len(h), 0
    high = h[::-1] * (-1.0) ** np.arange(taps)
    for x, f in ((low, h), (detail, high)):
        wide = np.zeros(2 * len(x))
        wide[::2] = x
        out = out + np.convolve(wide, f)[taps - 2 : 2 * len(x)]
    return out


def wavelet_denoise(y: np.ndarray, value: float, name: str = "db4") -> np.ndarray:
    """Soft-thresholds the details of a block one up, at each level by its largest one times the block's mean * (1 - value)."""
    h = scaling_filter(name)
    levels = int(math.log2(len(y) / (len(h) - 1))) if len(y) >= len(h) else 0
    if y.sum() <= 0 or levels < 1:
        return y
    low, details = y.astype(float) + 1, []
    cut = low.mean() * (1 - value)
    for _ in range(levels):
        low, detail = _split(low, h)
        details.append(detail)
    for d in reversed(details):
        d = np.sign(d) * np.maximum(np.abs(d) - cut * d.max(), 0)
        low = _join(low[: len(d)], d, h)
    return low[: len(y)] - 1


#: Positions of a block beyond which it isn't fitted in one task, and rows of a table that is broadcast, at most.
WIDE, BROADCAST_ROWS = 1 << 20, 200_000


def detrend_wide(signal: DataFrame, keys: Sequence[str], value: float, width: int, mix: float = 1.0, degree: int = 4) -> DataFrame:
    """keys, pos, value as poly_detrend() gives them, of blocks of any width: sums, not positions, are gathered.

    The least squares of a block need the sums of powers of the place and of their products with the value, aggregated
    map-side; the equations of each block (one row) are solved, and two more passes find the spreads of fit and rest.
    """
    block = F.expr(f"pos div {width}L")
    rows = signal.select(*keys, "pos", F.col("value").cast("double").alias("value"), block.alias("_block"))
    group = [*keys, "_block"]

    def met(stats: DataFrame) -> DataFrame:
        """rows with their block's figures: a row for each block, broadcast where these are few."""
        stats = stats.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(group)), *(c for c in stats.columns if c not in group))
        on = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)))
        return rows.join(F.broadcast(stats) if stats.count() <= BROADCAST_ROWS else stats, on).drop(*(f"_k{i}" for i in range(len(group))))

    some = F.when(F.col("value") != 0, F.col("pos"))
    ends = rows.groupBy(*group).agg(F.min(some).alias("_a"), F.max(some).alias("_z"), F.count(some).alias("_some"), F.sum("value").alias("_sum"))
    fits = (F.col("_sum") > 0) & (F.col("_some") >= degree + 2)
    x = F.lit(-1.0) + 2.0 * (F.col("pos") - F.col("_a")) / (F.col("_z") - F.col("_a"))
    inner = met(ends.where(fits)).where("pos between _a and _z").withColumn("_x", x)
    powers = [F.sum(F.pow("_x", F.lit(k))).alias(f"_x{k}") for k in range(2 * degree + 1)] + [F.sum(F.col("value") * F.pow("_x", F.lit(k))).alias(f"_y{k}") for k in range(degree + 1)]
    sums = inner.groupBy(*group).agg(F.first("_a").alias("_a"), F.first("_z").alias("_z"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"), F.min("value").alias("_low"), F.max("value").alias("_high"), *powers)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    kept = [*group, "_a", "_z", "_mean", "_std", "_low", "_high"]

    def solve(batches):
        for part in batches:
            fit = [np.linalg.solve([[r[f"_x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], [r[f"_y{i}"] - r["_std"] * value * r[f"_x{i}"] for i in range(degree + 1)]) for r in part.to_dict("records")]
            yield part[kept].assign(_fit=[f.tolist() for f in fit])

    solved = sums.mapInPandas(solve, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "_fit array<double>"]))
    line = F.aggregate(F.reverse("_fit"), F.lit(0.0), lambda acc, c: acc * F.col("_x") + c)
    fit = F.greatest(F.lit(0.0), F.least(line, F.col("_mean") + 5 * F.col("_std") * (1 - value)))

    def fitted(stats):
        return met(stats).where("pos between _a and _z").withColumn("_x", x).withColumn("_f", fit)

    first = lambda names: [F.first(c).alias(c) for c in names]
    figures = ["_a", "_z", "_mean", "_std", "_low", "_high", "_fit"]
    spread = fitted(solved).groupBy(*group).agg((F.max("_f") - F.min("_f")).alias("_range"), *first(figures))
    flat = F.greatest(F.lit(0.0), F.least(F.col("value") - F.col("_f"), F.col("_range")))
    full = fitted(spread).groupBy(*group).agg(F.min(flat).alias("_least"), (F.max(flat) - F.min(flat)).alias("_rest"), *first([*figures, "_range"]))
    done = fitted(full)
    scaled = F.when(F.col("_rest") > 0, F.col("_low") + (flat - F.col("_least")) * ((F.col("_high") - F.col("_low")) / F.col("_rest"))).otherwise(F.col("value"))
    changed = done.select(*keys, "pos", (mix * scaled + (1 - mix) * F.col("value")).alias("value"))
    marked = met(ends.withColumn("_fits", F.coalesce(fits, F.lit(False))))
    same = marked.where("not (_fits and pos between _a and _z)").select(*keys, "pos", "value")
    return changed.unionByName(same)


def filter_signal(signal: DataFrame, keys: Sequence[str], kind: str, value: float, width: int, over: int = 0, mix: float = 1.0) -> DataFrame:
    """keys, pos, value of a signal (all positions present) filtered in blocks of `width` that overlap by `over`.

    Blocks are fitted in one task each, wide ones of 'poly' by sums (detrend_wide). kind: 'poly', 'haar' (of blocks filled up to a power of two) or 'db<N>'; mix: the share of the filtered signal in the result. A position in two blocks has the value of the later one.
    """
    if kind == "poly" and width > WIDE and not over:
        return detrend_wide(signal, keys, value, width, mix)
    step = width - over
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - width + 1) / step))
    blocks = signal.select(*keys, "pos", "value", F.explode(F.sequence(first, F.floor(F.col("pos") / step))).alias("_block"))
    types = {f.name: f.dataType.simpleString() for f in signal.schema}

    def run(part):
        part = part.sort_values("pos")
        y = part["value"].to_numpy(float)
        if kind == "poly":
            return part.assign(value=poly_detrend(y, value, mix))
        return part.assign(value=mix * (haar_denoise(y, value) if kind == "haar" else wavelet_denoise(y, value, kind)) + (1 - mix) * y)

    done = blocks.groupBy(*keys, "_block").applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"pos {types['pos']}", "value double", "_block long"]))
    return done.groupBy(*keys, "pos").agg(F.max_by("value", "_block").alias("value")) if over else done.drop("_block")


def parse_spec(spec: str) -> dict[str, dict]:
    """`track:type,value,width,over,mix;...` as a dictionary."""
    out = {}
    for part in filter(None, spec.split(";")):
        track, _, rest = part.partition(":")
        fields = rest.split(",")
        if len(fields) != 5:
            raise ValueError(f"five parameters expected: {part}")
        out[track] = {"type": fields[0], "value": float(fields[1]), "width": int(float(fields[2])), "over": int(float(fields[3])), "mix": float(fields[4])}
    return out


#: The tracks that are filtered where nothing else is asked for, and how.
FILTERED = ("tlen_dis_rd", "left_smap_same", "left_smap_diff", "right_smap_same", "right_smap_diff")
DEFAULT = {"type": "poly", "value": 0.5, "width": 1_000_000_000, "over": 0, "mix": 1.0}


def filters_for(tracks: Sequence[str], spec: str | None = None) -> dict[str, dict]:
    """The filters of the tracks asked for: those of a specification, or else the default ones."""
    known = {t: dict(DEFAULT) for t in FILTERED} if spec is None else parse_spec(spec)
    return {t: f for t, f in known.items() if t in tracks}


def filter_tracks(signal: DataFrame, keys: Sequence[str], how: dict[str, dict]) -> DataFrame:
    """keys (with track), pos, value: each track through its filter; tracks without one stay as they are."""
    columns = [*keys, "pos", F.col("value").cast("double").alias("value")]
    out = signal.where(~F.col("track").isin(list(how))).select(*columns) if how else signal.select(*columns)
    for track, f in how.items():
        done = filter_signal(signal.where(F.col("track") == track).select(*columns), keys, f["type"], f["value"], f["width"], f["over"], f["mix"])
        out = out.unionByName(done.select(*keys, "pos", "value"))
    return out
