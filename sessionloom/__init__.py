"""Network connection-log analytics as composable Spark DataFrame operators."""
