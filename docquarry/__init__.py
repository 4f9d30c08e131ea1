"""docquarry: a PySpark-native engine for large collections of files and documents."""
