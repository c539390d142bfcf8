"""Trajectory, field and event analytics expressed as Spark DataFrame plans."""
