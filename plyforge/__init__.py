"""PySpark-native analytics for chess-position data and the records made from it."""
