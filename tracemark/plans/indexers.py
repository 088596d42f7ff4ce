"""Indexers turn decoded samples into rows of an index of their own; a library holds any number of them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig
from tracemark.operators.audio import find_audio_peaks, rms
from tracemark.operators.hashing import generate_hashes


class Indexer(Protocol):
    """Compute takes (song_id, sample_rate, samples) and gives rows with song_id."""

    name: str
    version: str
    sample_rate: int
    columns: str

    def compute(self, samples: DataFrame) -> DataFrame: ...


class FingerprintIndexer:
    """Landmark hashes."""

    name = "fingerprint"
    columns = "song_id long, hash int, anchor_time int"

    def __init__(self, cfg: FingerprintConfig = FingerprintConfig()):
        self.cfg, self.version, self.sample_rate = cfg, cfg.version(), cfg.sample_rate

    def compute(self, samples: DataFrame) -> DataFrame:
        return generate_hashes(find_audio_peaks(samples, self.cfg), self.cfg).select("song_id", "hash", "anchor_time")


class RmsIndexer:
    """The root mean square of a song, one row each."""

    name = "rms"
    columns = "song_id long, rms double"

    def __init__(self, version: str = "v1", sample_rate: int = 16_000):
        self.version, self.sample_rate = version, sample_rate

    def compute(self, samples: DataFrame) -> DataFrame:
        return samples.select("song_id", rms(F.col("samples")).alias("rms"))


def default_indexers(cfg: FingerprintConfig = FingerprintConfig()) -> list[Indexer]:
    """X3."""
    return [FingerprintIndexer(cfg)]
