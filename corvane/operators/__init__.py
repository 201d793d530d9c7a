"""Operators of the knowledge base; importing this package registers their queries."""

from corvane.operators import chunks, documents, events, facts, gates, graph, identity, lifecycle, metrics, objects, pages, readiness, rules, search, series, state

__all__ = ["chunks", "documents", "events", "facts", "gates", "graph", "identity", "lifecycle", "metrics", "objects", "pages", "readiness", "rules", "search", "series", "state"]
