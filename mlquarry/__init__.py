"""mlquarry: data preparation and statistical modelling as Spark DataFrame plans."""
