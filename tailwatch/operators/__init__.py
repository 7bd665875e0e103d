"""Per-row, per-key and cross-sectional operators, each ``DataFrame -> DataFrame``."""
