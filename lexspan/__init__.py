"""lexspan: literal, traceable text analytics as Spark DataFrame programs."""
