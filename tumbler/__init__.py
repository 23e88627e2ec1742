"""Draw-history analytics on Spark: DataFrame operators over item-set event streams."""
