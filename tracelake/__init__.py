"""Message, packet and trace analytics on Spark DataFrames."""
