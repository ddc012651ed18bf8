"""Binary deltas, byte-range similarity and training-data pipelines as Spark DataFrame operators."""
