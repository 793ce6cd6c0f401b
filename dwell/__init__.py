"""Dwell: waiting-time (time-to-event) analytics expressed as Spark plans."""
