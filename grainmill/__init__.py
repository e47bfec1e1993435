"""Spark-first engine for building and inspecting language-model corpora."""
