"""ledgerlark: a Spark-first analytics engine for card-payment event data."""
