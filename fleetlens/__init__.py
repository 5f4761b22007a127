"""fleetlens: mobile-robot fleet analytics as Spark DataFrame operators."""
