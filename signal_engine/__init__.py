"""A PySpark-native analytics engine: DataFrame operators for record resolution,
signal analysis, evidence checks, scoring, fusion, audiences and event feeds."""
