"""quirefold: a PySpark-native document-analytics engine."""
