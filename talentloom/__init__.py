"""Résumé and job matching, and corpus preparation, as Spark jobs."""
