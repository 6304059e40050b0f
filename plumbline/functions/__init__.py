"""Column-to-Column helpers; all of them stay inside Spark SQL expressions."""
