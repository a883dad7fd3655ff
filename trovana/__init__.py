"""trovana: a Spark-native engine for searching and analysing file-metadata catalogs."""
