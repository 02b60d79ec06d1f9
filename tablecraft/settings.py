"""Thresholds and bounds used across the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Curation, insight and training thresholds.
    null_drop_threshold: float = 0.7
    categorical_threshold: int = 20
    outlier_iqr_multiplier: float = 1.5
    correlation_strong: float = 0.7
    correlation_moderate: float = 0.4
    skew_threshold: float = 1.0
    imbalance_ratio: float = 0.6
    high_cardinality: int = 50
    low_variance: float = 0.01
    test_size: float = 0.2
    val_size: float = 0.1
    random_state: int = 42
    classification_unique: int = 20
    variance_threshold: float = 0.01
    correlation_drop: float = 0.95
    onehot_max_categories: int = 20
    date_detect_ratio: float = 0.8
    date_feature_ratio: float = 0.3
    float32_tolerance: float = 5e-4

    # Bounds on what may be held by one task, broadcast or sent to the driver.
    exact_rows: int = 200_000
    broadcast_rows: int = 100_000
    broadcast_bytes: int = 32 * 1024 * 1024
    hot_keys: int = 1_000
    forest_rows: int = 1_000_000
    spread: int = 4_096
    grid_classes: int = 1_000
    columns_per_job: int = 40


SETTINGS = Settings()
