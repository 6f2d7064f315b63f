"""gridloom: a PySpark-native engine for geospatial tile, raster and catalogue analytics."""
