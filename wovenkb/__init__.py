"""wovenkb: a PySpark-native engine for multi-hop retrieval over an event-entity table."""
