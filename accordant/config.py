"""Parameters, checked on the driver before any plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass

from accordant.functions.special import normal_quantile


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(what)


@dataclass(frozen=True)
class DetectorConfig:
    """The magnitude detector: chi-square windows and two-sided CUSUM per channel."""

    window_len: int = 64
    min_samples: int = 32
    min_channels: int = 2
    max_seq_gap: int = 1
    max_timestamp_skew_ms: int = 1_000
    max_inter_sample_gap_ms: int = 10_000
    max_tracks: int = 1_024
    nis_alpha: float = 0.01
    cusum_slack: float = 3 / math.sqrt(6)
    cusum_threshold: float = 15 / math.sqrt(6)
    jam_fraction: float = 0.6

    def __post_init__(self) -> None:
        _need(1 <= self.min_samples <= self.window_len <= 65_536, "1 <= min_samples <= window_len <= 65536")
        _need(2 <= self.min_channels <= 6, "min_channels is 2 to 6")
        _need(self.max_seq_gap >= 1 and self.max_timestamp_skew_ms >= 0 and self.max_inter_sample_gap_ms >= 1 and self.max_tracks >= 1, "gaps, skew and tracks must be positive")
        _need(1e-300 <= self.nis_alpha < 1, "nis_alpha is in [1e-300, 1)")
        _need(math.isfinite(self.cusum_slack) and self.cusum_slack >= 0 and math.isfinite(self.cusum_threshold) and self.cusum_threshold > 0, "CUSUM slack is >= 0, its threshold > 0")
        _need(0 < self.jam_fraction <= 1, "jam_fraction is in (0, 1]")


@dataclass(frozen=True)
class CorrelationConfig:
    """Signed correlation of channels. ``family_alpha`` is for all axes; it is divided by axes once, then by pairs."""

    window: int = 128
    min_samples: int = 64
    decouple_ratio: float = 0.4
    corr_floor: float = 0.15
    family_alpha: float = 0.01
    axes: int = 1

    def __post_init__(self) -> None:
        _need(4 <= self.min_samples <= self.window <= 65_536, "4 <= min_samples <= window <= 65536")
        _need(0 < self.decouple_ratio < 1 and 0 < self.corr_floor < 1 and 0 < self.family_alpha < 1, "ratio, floor and alpha are in (0, 1)")
        _need(1 <= self.axes <= 3, "there are 1 to 3 axes")

    def for_axes(self, axes: int) -> CorrelationConfig:
        """The budget of one axis; dividing twice is an error."""
        _need(self.axes == 1, "the family budget is already divided by axes")
        return CorrelationConfig(self.window, self.min_samples, self.decouple_ratio, self.corr_floor, self.family_alpha, axes)

    def significance_floor(self, samples: int, channels: int) -> float:
        """Fisher's floor for a window of ``samples``; 1 or more can't be used."""
        pairs = channels * (channels - 1) // 2
        if pairs < 1 or samples <= 3:
            return 1.0
        tail = self.family_alpha / self.axes / pairs
        if 1.0 - tail >= 1.0:
            return 1.0
        return math.tanh(normal_quantile(1.0 - tail) / math.sqrt(samples - 3))

    def floors(self, channels: int) -> list[float]:
        """The floor by number of samples, from 0 to the window."""
        return [self.significance_floor(n, channels) for n in range(self.window + 1)]


@dataclass(frozen=True)
class ScenarioConfig:
    """A deterministic scenario: frames of correlated channels, and what is done to one of them."""

    frames: int = 220
    sigma: float = 1.0
    rho: float = 0.0
    dt_ms: int = 100
    seed: int = 7

    def __post_init__(self) -> None:
        _need(1 <= self.frames <= 10_000_000 and self.dt_ms >= 1, "frames and dt_ms must be positive")
        _need(math.isfinite(self.sigma) and self.sigma > 0, "sigma is > 0")
        _need(0 <= self.rho < 1, "rho is in [0, 1)")
        _need(0 <= self.seed < 2**64, "the seed is an unsigned 64-bit integer")


@dataclass(frozen=True)
class JsonlLimits:
    """Ceilings of a bounded JSON Lines scan."""

    max_line_bytes: int = 64 * 1024
    max_records: int = 100_000
    max_total_bytes: int = 64 * 1024 * 1024
    max_streams: int = 8_192

    def __post_init__(self) -> None:
        _need(min(self.max_line_bytes, self.max_records, self.max_total_bytes, self.max_streams) >= 1, "limits are at least 1")
        _need(self.max_total_bytes >= self.max_line_bytes, "the total is at least a line")
