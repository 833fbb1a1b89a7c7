"""Viaduct: a Spark-native engine for road networks, traffic weights and bulk relational analytics."""
