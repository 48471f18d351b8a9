"""Multichannel signal mining and training-data preparation on Spark."""
