"""Training-data pipeline operators. Nothing outside this folder imports it, ``__spark_entry__`` excepted."""
