"""Checks of the library against SQL on tables derived from the given `events` table."""
