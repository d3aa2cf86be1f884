"""Incremental capture: the job queue and landed results as streams."""
