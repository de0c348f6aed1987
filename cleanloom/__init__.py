"""A Spark-native engine that profiles, standardises, repairs, deduplicates and validates messy tables."""
