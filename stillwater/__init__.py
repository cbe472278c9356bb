"""Stillwater: detector-study analytics and corpus preparation as Spark jobs."""
