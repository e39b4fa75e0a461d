"""Column builders: scalar expressions, per-instrument factors, window aggregates, cross-sectional factors."""
