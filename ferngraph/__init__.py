"""ferngraph: code-architecture analytics as composable Spark DataFrame operators."""
