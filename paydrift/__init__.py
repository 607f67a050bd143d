"""Payment-portfolio movement analytics as PySpark DataFrame jobs."""
