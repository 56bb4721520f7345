"""Market analytics for sports totals, written as Spark DataFrame transformations."""
