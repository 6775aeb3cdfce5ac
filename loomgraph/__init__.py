"""loomgraph: a PySpark-native engine for analysing document collections."""
