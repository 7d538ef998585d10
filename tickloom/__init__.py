"""Tick programs over tables and streams of sensor readings, on Spark."""
