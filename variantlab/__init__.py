"""Paired-experiment analytics on Spark: arms, pairs, sparse features, thresholds, models and metrics."""
