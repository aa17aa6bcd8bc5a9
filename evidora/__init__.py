"""Spark-first retrieval and evidence analytics: lazy DataFrame-to-DataFrame operators."""
