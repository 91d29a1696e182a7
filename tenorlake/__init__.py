"""Options-volatility research tables and training-data jobs as Spark DataFrame operators."""
