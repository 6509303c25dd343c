"""feedforge: developer-activity analytics expressed as Spark DataFrame plans."""
