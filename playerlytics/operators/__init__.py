"""DataFrame operators: cleaning, rollups, LTV, retention, segmentation, cluster profiles."""
