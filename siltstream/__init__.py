"""Siltstream: Spark jobs over honeypot logs and, in ``llm``, over training text."""
