"""Defaults of the engine's parameters. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Decay:
    base_rate: float = 0.1
    access_boost: float = 0.05
    importance_multiplier: float = 1.5
    adaptive_factor: float = 0.01
    min_strength: float = 0.1


@dataclass(frozen=True)
class Prediction:
    relevance_threshold: float = 0.6
    context_window: int = 10
    min_confidence: float = 0.7
    horizon_ms: int = 7 * DAY_MS
    smoothing: float = 0.2
    state_window: int = 5
    forecast_steps: int = 5
    reference_depth: int = 2


@dataclass(frozen=True)
class Metrics:
    window_ms: int = DAY_MS
    smoothing: float = 0.1
    critical: float = 0.9
    warning: float = 0.7
    normal: float = 0.5
    horizon: int = 5
    anomaly_window: int = 30


@dataclass(frozen=True)
class Statistics:
    confidence: float = 0.95
    significance: float = 0.05
    smoothing: float = 0.3
    rolling: int = 50


@dataclass(frozen=True)
class Correlation:
    min_correlation: float = 0.3
    max_lag: int = 30


@dataclass(frozen=True)
class Partitions:
    max_size: int = 10_000
    min_size: int = 1000
    similarity: float = 0.7
    imbalance: float = 0.2


@dataclass(frozen=True)
class Cache:
    max_bytes: int = 100 * 1024 * 1024
    ttl_ms: int = 30 * 60_000
    high_water: float = 0.8
    low_water: float = 0.6


@dataclass(frozen=True)
class Pool:
    timeout_ms: int = 30_000
    priority_threshold: int = 5
    efficiency_decay: float = 0.1
    scaling_factor: float = 0.5
    resource_threshold: float = 0.8
    min_workers: int = 2
    max_workers: int = 8


@dataclass(frozen=True)
class Listing:
    item_height: int = 50
    overscan: int = 3
    container_height: int = 400
    batch_size: int = 50
