"""Signal analytics on Spark: ranked items, selection, classification, reporting."""
