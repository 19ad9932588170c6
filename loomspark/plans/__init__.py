"""Queries by name. Importing this package registers all of them."""

from loomspark.plans import analysis, consolidation, documents, parameters, positions, relational, retrieval, stance, integrity, texts, themes, tuning  # noqa: F401
