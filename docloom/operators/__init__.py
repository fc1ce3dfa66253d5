"""Operators over tables: storage and constraints, reports, class scoring, phrases, topics, clusters, contents."""
