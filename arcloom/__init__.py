"""Spark-native analytics for shared-arc polygon topologies."""
