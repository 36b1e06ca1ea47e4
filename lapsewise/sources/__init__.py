"""Reading and writing tables: sales lines, hand-over tables and the decision store."""
