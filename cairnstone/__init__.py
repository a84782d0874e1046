"""cairnstone: a PySpark-native engine for context stores, cluster analytics and corpus work."""
