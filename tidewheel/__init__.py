"""Spark-native analytics over an append-only event log of deployed models."""
