"""folio: a PySpark-native engine for collections of documents held as tables."""
