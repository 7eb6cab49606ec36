"""Labelled text collections on Spark: cleaning, dedup, quotas, augmentation, selection, features and metrics."""
