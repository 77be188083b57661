"""Generic table operators the pipelines are built from."""
