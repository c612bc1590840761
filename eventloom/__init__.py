"""eventloom: process-mining analytics over event data as lazy Spark plans."""
