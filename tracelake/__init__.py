"""tracelake: product-evidence analytics expressed as Spark DataFrame plans."""
