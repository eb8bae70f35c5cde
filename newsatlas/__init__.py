"""newsatlas: news-corpus analytics as PySpark DataFrame jobs."""
