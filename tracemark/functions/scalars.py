"""Column expressions: hash packing, units, scores, labels and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemark.config import FingerprintConfig, Limits, MatchConfig

# fixed value: audio file extensions
AUDIO_EXTENSIONS = (".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac", ".opus", ".webm")


def pack_hash(f1: Column, f2: Column, dt: Column, cfg: FingerprintConfig = FingerprintConfig()) -> Column:
    """Two bins and their distance in one int."""
    placed = [F.shiftleft(c.cast("int"), cfg.layout.shift(part)) for part, c in {"f1": f1, "f2": f2, "dt": dt}.items()]
    return reduce(Column.bitwiseOR, placed).cast("int")


def unpack_hash(h: Column, cfg: FingerprintConfig = FingerprintConfig()) -> tuple[Column, Column, Column]:
    """(f1, f2, dt)."""
    return tuple(F.shiftright(h, cfg.layout.shift(part)).bitwiseAND(F.lit(cfg.layout.values(part)[-1])) for part, _ in cfg.layout.parts)


def frames_to_seconds(frames: Column, cfg: FingerprintConfig = FingerprintConfig()) -> Column:
    """P3."""
    return frames * float(cfg.hop_length) / float(cfg.sample_rate)


def seconds_to_frames(seconds: Column, cfg: FingerprintConfig = FingerprintConfig()) -> Column:
    return seconds * float(cfg.sample_rate) / float(cfg.hop_length)


def bin_to_hz(f: Column, cfg: FingerprintConfig = FingerprintConfig()) -> Column:
    return f * cfg.hz_per_bin


def confidence_score(best: Column, runner_up: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    """How far the best stands out, times how much there is of it; 0 without a best."""
    return F.when(best <= 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - runner_up / best) * F.least(F.lit(1.0), best / float(cfg.confidence_saturation)))


def is_match(aligned: Column, confidence: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    """P5."""
    return (aligned >= cfg.min_aligned_matches) & (confidence >= cfg.min_confidence)


def shown_offset(seconds: Column) -> Column:
    """Offsets are shown from 0 on, to the millisecond, half to even."""
    return F.bround(F.greatest(F.lit(0.0), seconds), 3)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without its last extension; a name that only begins with a point has none."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*AUDIO_EXTENSIONS)


def title_or_stem(title: Column, path: Column) -> Column:
    """P9."""
    return F.coalesce(F.nullif(title, F.lit("")), stem(path))


def track_id_from_path(path: Column) -> Column:
    """A base name of exactly six digits and .mp3, else null."""
    return F.nullif(F.regexp_extract(file_name(path), r"^(\d{6})\.mp3$", 1), F.lit("")).cast("long")


def track_path(track_id: Column) -> Column:
    """000/000002.mp3 of 2."""
    name = F.lpad(track_id.cast("string"), 6, "0")
    return F.concat(F.substring(name, 1, 3), F.lit("/"), name, F.lit(".mp3"))


def source_tag(track_id: Column, uploaded: Column | None = None) -> Column:
    """P10: upload, fma for a known track id, else file."""
    tag = F.when(track_id.isNotNull(), "fma").otherwise("file")
    return tag if uploaded is None else F.when(uploaded, "upload").otherwise(tag)


def human_bytes(n: Column) -> Column:
    """P11."""
    n = n.cast("double")
    return (F.when(n < 1024, F.format_string("%.1f B", n)).when(n < 1024.0 ** 2, F.format_string("%.1f KB", n / 1024.0))
            .when(n < 1024.0 ** 3, F.format_string("%.1f MB", n / 1024.0 ** 2)).otherwise(F.format_string("%.1f GB", n / 1024.0 ** 3)))


def position_label(seconds: Column) -> Column:
    """M:ss, with 0:00 for what is negative or no number."""
    s = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), F.lit(0.0)).otherwise(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), F.floor(s % 60).cast("long"))


def exact_position_label(seconds: Column) -> Column:
    """M:ss.s of offsets from 0 on."""
    tenths = F.bround(F.greatest(F.lit(0.0), seconds) % 60, 1)
    return F.format_string("%d:%04.1f", F.floor(F.greatest(F.lit(0.0), seconds) / 60).cast("long"), tenths)


def title_label(title: Column) -> Column:
    """P13."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Untitled"))


def artist_label(artist: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(artist), F.lit("")), F.lit("Unknown artist"))


def confidence_label(c: Column) -> Column:
    """P14."""
    return F.when(c >= 0.8, "Very high").when(c >= 0.55, "High").when(c >= 0.35, "Good").otherwise("Fair")


def seeded_order(seed, *keys: Column) -> Column:
    """A fixed pseudo-random order: the MD5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_uniform(seed, *keys: Column) -> Column:
    """A number from 0 to below 1 that depends on the seed and the keys only."""
    return F.conv(F.substring(seeded_order(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def reject_upload(content: Column, limit: int = Limits.identify_bytes) -> Column:
    """F8: why an upload is not taken, or null."""
    return F.when(content.isNull() | (F.length(content) == 0), "empty").when(F.length(content) > limit, "too large")
