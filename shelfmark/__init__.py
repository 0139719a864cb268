"""Document selection, text features, classification and evaluation as Spark DataFrame transformations."""
