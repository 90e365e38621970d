"""geoloom: a PySpark-native engine for multi-temporal change evidence over gridded observations."""
