"""Set-oriented document analytics and retrieval on Apache Spark."""
