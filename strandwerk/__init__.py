"""strandwerk: a Spark-native engine for company knowledge graphs and entity resolution.

Every operator takes DataFrames and returns a DataFrame.  Nothing here collects
data that grows with the input to the driver.
"""
