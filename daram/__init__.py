"""daram: PySpark-native processing of underwriting documents, mappings and corrections."""
