"""A PySpark-native engine for measurement panels: assembly, cleaning and profiling."""
