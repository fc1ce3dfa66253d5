"""Document analytics on Spark: typed tables, text operators, topic and class models, reports and pipelines."""
