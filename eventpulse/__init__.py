"""Analytics over the records of a multi-venue event, as Spark DataFrame operators."""
