"""sparkloom: list algebra and dataset-pipeline operators on Spark DataFrames."""
