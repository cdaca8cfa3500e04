"""Spark-native analytics for gridded-spectrum surveys: time streams, maps, mode cleaning, power spectra."""
