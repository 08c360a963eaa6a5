"""Relational operators: sessions, detection, clustering, reports, indicators, retention."""
