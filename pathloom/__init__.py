"""pathloom: clickstream flow mining as composable Spark DataFrame operators."""
