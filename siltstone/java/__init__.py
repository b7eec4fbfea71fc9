"""A tolerant Java parser in plain Python; it runs inside executors and knows nothing of Spark."""
