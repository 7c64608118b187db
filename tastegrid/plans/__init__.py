"""Whole jobs and the workload run over the given tables."""
