"""Match-event analytics written against the Spark DataFrame API."""
