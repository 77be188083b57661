"""Blob inclusion and block propagation analytics as Spark DataFrame functions."""
