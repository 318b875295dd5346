"""Measure, screen and prepare archives of recordings, held as Spark tables of sample blocks."""
