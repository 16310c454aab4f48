"""inkfold: sensitive-data redaction, audit and corpus analytics as Spark DataFrame jobs."""
