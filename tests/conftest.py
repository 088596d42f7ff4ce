import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def song(seed: int, seconds: float = 30.0, rate: int = 11_025) -> np.ndarray:
    """A made signal: for every beat of a random tempo a chirp that glides between two random pitches, over a filtered
    pulse train whose period drifts. It has a spectrum full of local maxima, and differs from seed to seed."""
    draw = np.random.default_rng((seed, 77))
    clock = np.arange(int(seconds * rate)) / rate
    beat = draw.uniform(0.17, 0.33)
    slot = (clock / beat).astype(int)
    edges = draw.uniform(np.log(220.0), np.log(4200.0), slot.max() + 2)
    inside = clock / beat - slot
    pitch = np.exp(edges[slot] * (1 - inside) + edges[slot + 1] * inside)
    phase = np.cumsum(pitch) / rate
    chirps = (1 - inside) ** 2 * (np.cos(2 * np.pi * phase) + 0.4 * np.cos(4 * np.pi * phase + 1.0))
    period = 90 + 40 * np.sin(2 * np.pi * clock / draw.uniform(3.0, 7.0) + draw.uniform(0, 6.28))
    pulses = np.diff(np.floor(np.cumsum(1 / period)), prepend=0.0)
    ring = np.exp(-np.arange(200) / 25.0) * np.cos(np.arange(200) * draw.uniform(0.2, 1.2))
    mixed = chirps + 0.7 * np.convolve(pulses, ring)[:len(clock)]
    return (0.8 * mixed / max(np.ptp(mixed) / 2, 1e-9)).astype(np.float32)


def noisy(x: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """x and uniform noise whose power is snr_db below it."""
    noise = np.random.default_rng((seed, 5)).uniform(-1.0, 1.0, len(x))
    share = 10 ** (-snr_db / 20) * np.linalg.norm(x) / np.linalg.norm(noise)
    return (x + share * noise).astype(np.float32)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
