"""Table sources, sinks and profiling."""
