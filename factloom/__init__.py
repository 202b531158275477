"""factloom: program facts and training-data tables as Spark queries."""
