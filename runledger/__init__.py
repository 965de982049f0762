"""Run-telemetry analytics as Spark DataFrame operators."""
