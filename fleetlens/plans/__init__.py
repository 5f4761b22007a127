"""Report pipelines: named, lazily evaluated results over the model tables."""
