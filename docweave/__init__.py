"""docweave: a PySpark-native engine that turns a corpus of scanned documents into typed tables."""
