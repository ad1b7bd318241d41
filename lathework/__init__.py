"""lathework: DataFrame operators for preparing, scoring and retrieving AI data on Spark."""
