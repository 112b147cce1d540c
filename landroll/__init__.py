"""Land-claim and official-statistics data jobs as plain Spark DataFrame functions."""
