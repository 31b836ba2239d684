"""Polyphony: response-diversity analytics on Spark."""
