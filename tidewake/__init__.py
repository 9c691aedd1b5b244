"""tidewake: a PySpark-native engine for maritime spatio-temporal fusion."""
