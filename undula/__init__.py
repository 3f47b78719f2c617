"""undula: multi-channel signal-quality analytics on Spark DataFrames."""
