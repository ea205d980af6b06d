"""A PySpark-native analytics engine for versioned planning data, text, space, graphs and streams."""
