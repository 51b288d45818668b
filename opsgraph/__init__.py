"""PySpark-native analytics over IT-operations graphs, tickets and their texts."""
