"""Image-text topic and label analytics as Spark DataFrame operators."""
