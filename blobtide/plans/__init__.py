"""The analysis pipelines: blob inclusion, fees, resubmission and block propagation."""
