"""weftline: retrieval, text and property-graph operators as lazy Spark DataFrame operators."""
