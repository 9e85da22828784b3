"""Code-dependency analytics expressed as Spark DataFrame programs."""
