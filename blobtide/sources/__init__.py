"""Table scans, the rollup dimension, and file sources and sinks."""
