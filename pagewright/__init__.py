"""pagewright: web pages and documents to clean, chunked, counted text, as Spark jobs."""

__version__ = "0.1.0"
