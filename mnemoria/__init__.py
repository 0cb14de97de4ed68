"""A PySpark-native engine for source-backed conversational and document memory."""
