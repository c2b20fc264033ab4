"""Settings: weights, thresholds and sizes, all of which can be overridden."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Settings:
    # fixed values: fusion weights, level thresholds, severity weights and sizes
    text_weight: float = 1.0
    signature_weight: float = 0.85
    audio_weight: float = 0.45
    suspicious: float = 0.35
    high: float = 0.65
    margin: float = 0.05
    severity_weights: dict = field(default_factory=lambda: {1: 0.12, 2: 0.22, 3: 0.35})
    other_severity_weight: float = 0.15
    rolling_chars: int = 3000
    max_sessions: int = 500
    window_tokens: int = 256
    window_stride: int = 128
    max_tokens: int = 512
    min_window_tokens: int = 8
    sample_rate: int = 16_000
    window_samples: int = 64_000

    def override(self, **values) -> Settings:
        """A copy with other values; unknown names raise."""
        return replace(self, **values)

    @classmethod
    def from_conf(cls, spark, prefix: str = "spark.calltriage.") -> Settings:
        """Numbers set in the session's configuration, the rest as declared."""
        base = cls()
        found = {}
        for name, value in vars(base).items():
            if isinstance(value, (int, float)) and (text := spark.conf.get(prefix + name, None)) is not None:
                found[name] = type(value)(text)
        return base.override(**found)
