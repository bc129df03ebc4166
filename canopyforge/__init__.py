"""Spark-native analytics for airborne, drone and terrestrial point clouds."""
