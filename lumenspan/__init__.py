"""Interval, transcript, signal and log analytics on Spark."""
