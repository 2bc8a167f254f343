"""A PySpark-native engine for analysing Python source trees as data."""
