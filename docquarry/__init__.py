"""Spark-first document analytics: relational operators over blocks, sections, requirements and text corpora."""
