"""Log-template mining on Spark."""
