"""pulseline: public-transport vehicle analytics on PySpark DataFrames."""
