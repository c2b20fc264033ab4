"""Waveforms as arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings


def fit_window(samples: Column, length: int | None = None) -> Column:
    """Zeros at the end of a short waveform, the centre of a long one."""
    n, want = F.size(samples), length or Settings().window_samples
    zero = F.lit(0.0).cast("float")
    return F.when(n < want, F.concat(samples, F.array_repeat(zero, F.greatest(want - n, F.lit(0))))).when(n > want, F.slice(samples, F.greatest(F.floor((n - want) / 2), F.lit(0)).cast("int") + 1, want)).otherwise(samples)


def crop_start(n: Column, key: Column, epoch: int, length: int, seed: int = 42) -> Column:
    """Where the stretch of ``length`` of n samples begins, from 0: a hash of key, epoch and seed."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(epoch)), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return h % F.greatest(n - length + 1, F.lit(1))


def random_crop(samples: Column, key: Column, epoch: int, length: int, seed: int = 42) -> Column:
    """A stretch of a long waveform that follows from key, epoch and seed alone."""
    start = crop_start(F.size(samples), key, epoch, length, seed).cast("int")
    return F.when(F.size(samples) > length, F.slice(samples, start + 1, length)).otherwise(fit_window(samples, length))


def mono_mixdown(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: ((a + b) / 2).cast("float"))


def resample_linear(samples: Column, rate_in: int, rate_out: int) -> Column:
    """Linear interpolation to another rate, the last point left out; beyond the last sample its value holds."""
    n = F.size(samples)
    m = F.bround(n / F.lit(rate_in) * rate_out).cast("int")
    at = lambda i: F.get(samples, F.least(i, n - 1).cast("int")).cast("double")

    def value(k: Column) -> Column:
        x = k * n / m
        low = F.floor(x)
        return (at(low) + (at(low + 1) - at(low)) * (x - low)).cast("float")

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), value)).when(samples.isNotNull(), F.array().cast("array<float>"))


