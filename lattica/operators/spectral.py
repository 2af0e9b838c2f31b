"""Spectra of gridded fields: transforms of batches of fields, radial and Welch spectra as grouped NumPy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.fields import on_fields

KM_PER_DEGREE = 111.32


def rfft2(df: DataFrame, height: int, width: int, keys: list[str], values: list[str]) -> DataFrame:
    """Real 2-D transform of fields: (keys, ky, kx, re_<v>, im_<v>). Missing cells and nulls count as 0."""

    def kernel(field: np.ndarray) -> list[np.ndarray]:
        c = np.fft.rfft2(field)
        return [c.real, c.imag]

    names = [f"{part}_{v}" for v in values for part in ("re", "im")]
    return on_fields(df, {"y": height, "x": width}, keys, values, kernel, {"ky": height, "kx": width // 2 + 1}, names)


def power(coefficients: DataFrame, a: str, b: str, eps: float = 1e-6) -> DataFrame:
    """Mean power of both, ratio and coherence per wavenumber."""
    ra, ia, rb, ib = (F.col(f"{p}_{v}") for v in (a, b) for p in ("re", "im"))
    mean = coefficients.groupBy("ky", "kx").agg(
        F.avg(ra * ra + ia * ia).alias("power_a"), F.avg(rb * rb + ib * ib).alias("power_b"), F.avg(ra * rb + ia * ib).alias("_re"), F.avg(ia * rb - ra * ib).alias("_im")
    )
    cross = F.sqrt(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"))
    coherence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cross / (F.sqrt("power_a") * F.sqrt("power_b") + eps)))
    return mean.select("ky", "kx", "power_a", "power_b", (F.col("power_b") / (F.col("power_a") + eps)).alias("ratio"), coherence.alias("coherence"))


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def segments(n: int, size: int, overlap: int) -> list[int]:
    return list(range(0, n - size + 1, size - overlap)) if n >= size else [0]


def radial_power(field: np.ndarray, lat: np.ndarray, dx: float, dy: float, n_bins: int, size: int = 256, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of spectral power in log-spaced wavelength bins, over all windows of a field; and the bins' centres.

    Row i of a transform takes latitude row i. Bins come from the first window's first row and are closed below only.
    """
    h, w = min(size, field.shape[0]), min(size, field.shape[1])
    step_y, step_x = (h // 2 if overlap is None else overlap), (w // 2 if overlap is None else overlap)
    edges, total, count = None, np.zeros(n_bins - 1), np.zeros(n_bins - 1)
    taper = np.outer(hann(h), hann(w))
    for i in segments(field.shape[0], h, min(step_y, h - 1)):
        for j in segments(field.shape[1], w, min(step_x, w - 1)):
            part = field[i : i + h, j : j + w]
            p = np.abs(np.fft.rfft2((part - part.mean()) * taper)) ** 2
            ky = np.fft.fftfreq(h, dy * KM_PER_DEGREE)
            kx = np.fft.rfftfreq(w, dx * KM_PER_DEGREE)[None, :] / np.cos(np.deg2rad(lat[i : i + h]))[:, None]
            k = np.sqrt(ky[:, None] ** 2 + kx**2)
            length = np.divide(1.0, k, out=np.full_like(k, np.inf), where=k > 0)
            if edges is None:
                first = length[0][np.isfinite(length[0])]
                edges = np.geomspace(first.min(), first.max(), n_bins)
            at = np.searchsorted(edges, length, "right") - 1
            ok = np.isfinite(length) & (at >= 0) & (at < n_bins - 1)
            total += np.bincount(at[ok], p[ok], n_bins - 1)
            count += np.bincount(at[ok], minlength=n_bins - 1)
    return (edges[1:] + edges[:-1]) / 2, total, count


def radial_spectrum(df: DataFrame, value: str, dx: float, dy: float, n_bins: int = 40, size: int = 256, overlap: int | None = None, field: str | list[str] = "t") -> DataFrame:
    """(bin, wavelength_km, power): power per wavelength over all fields. field: what a field is (time, member). One task holds one field, never the archive; sums
    meet in an aggregation."""
    keys = [field] if isinstance(field, str) else list(field)


    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="y", columns="x", values=value).to_numpy(float)
        lat = pdf.groupby("y")["lat"].first().to_numpy(float)
        centre, total, count = radial_power(np.nan_to_num(grid), lat, dx, dy, n_bins, size, overlap)
        return pd.DataFrame({"bin": np.arange(len(centre)), "wavelength_km": centre, "total": total, "n": count.astype("int64")})

    parts = df.select(*keys, "y", "x", "lat", value).groupBy(*keys).applyInPandas(kernel, "bin long, wavelength_km double, total double, n long")
    return parts.groupBy("bin").agg(F.avg("wavelength_km").alias("wavelength_km"), F.try_divide(F.sum("total"), F.sum("n")).alias("power"))


def welch(x: np.ndarray, size: int = 50, overlap: int = 30, nfft: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density along the last axis with unit sampling, constant detrend and Hann windows; without the zero frequency."""
    size = min(size, x.shape[-1])
    nfft, overlap, window = max(nfft, size), min(overlap, size - 1), hann(min(size, x.shape[-1]))
    total, starts = 0.0, segments(x.shape[-1], size, overlap)
    for s in starts:
        part = x[..., s : s + size]
        p = np.abs(np.fft.rfft((part - part.mean(axis=-1, keepdims=True)) * window, nfft)) ** 2 / (window**2).sum()
        p[..., 1 : -1 if nfft % 2 == 0 else None] *= 2
        total = total + p
    return np.fft.rfftfreq(nfft)[1:], (total / len(starts))[..., 1:]


def welch_rows(df: DataFrame, value: str, keys: list[str], along: str = "x", **options) -> DataFrame:
    """(keys, freq, density) of each line of cells along an axis."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        freq, density = welch(pdf.sort_values(along)[value].to_numpy(float), **options)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(freq) for k in keys}, "k": np.arange(1, len(freq) + 1), "freq": freq, "density": density})

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, along, value).groupBy(*keys).applyInPandas(kernel, f"{kinds}, k long, freq double, density double")


def psd_cube(maps: DataFrame, value: str, keys: list[str], sizes: list[int], nfft: int = 0) -> DataFrame:
    """(keys, along, size, k, freq, density): mean density of the lines along x and along y, for every window size (half overlap, transforms
    of the size, or nfft if that is more). keys: what a map is (variable, model, season). Each line is dealt out once for all sizes."""
    both = [F.struct(F.lit(along).alias("along"), F.col(line).alias("line"), F.col(along).alias("at")) for along, line in (("x", "y"), ("y", "x"))]
    lines = maps.select(*keys, value, F.explode(F.array(*both)).alias("p")).select(*keys, value, "p.*")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = pdf.sort_values("at")[value].to_numpy(float), []
        for n in sizes:
            freq, density = welch(x, size=n, overlap=n // 2, nfft=max(nfft, n))
            out.append(pd.DataFrame({"size": n, "k": np.arange(1, len(freq) + 1), "freq": freq, "density": density}))
        out = pd.concat(out)
        for k in [*keys, "along"]:
            out[k] = pdf[k].iloc[0]
        return out

    kinds = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys)
    per_line = lines.groupBy(*keys, "along", "line").applyInPandas(kernel, f"size int, k long, freq double, density double, {kinds}, along string")
    return per_line.groupBy(*keys, "along", "size", "k").agg(F.avg("freq").alias("freq"), F.avg("density").alias("density"))


def row_share(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """value as a share of its row's total; rows that sum to 0 stay as they are."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(total, by).withColumn(value, F.col(value) / F.coalesce(F.nullif("_total", F.lit(0.0)), F.lit(1.0))).drop("_total")
