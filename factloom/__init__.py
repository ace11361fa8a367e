"""factloom: a PySpark-native engine for turning documents and change feeds into facts."""
