"""A PySpark-native engine for grouped N-dimensional data: catalogues, transforms, patches, metrics and reports."""
