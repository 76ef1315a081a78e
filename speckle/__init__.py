"""PySpark-native analysis of sparse diffraction frames."""
