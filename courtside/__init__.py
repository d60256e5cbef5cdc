"""courtside: roster analytics expressed as Spark DataFrame plans."""
