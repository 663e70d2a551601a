"""evidentia: a PySpark-native evidence retrieval and argument assembly engine."""

__version__ = "0.1.0"
