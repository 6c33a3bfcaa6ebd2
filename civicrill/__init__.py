"""Analytics over public municipal records, written as plain Spark DataFrame programs."""
