"""The verbs of relations."""
