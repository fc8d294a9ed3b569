"""tarnwork: a PySpark-native engine for building, auditing and evaluating detection datasets."""
