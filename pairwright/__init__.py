"""Pair-evidence analytics on Spark: candidate queues, canonical pairs, samples, metrics and audits."""
