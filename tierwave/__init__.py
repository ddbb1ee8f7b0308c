"""tierwave: multi-resolution summaries of signals along an ordered axis, as Spark jobs."""
