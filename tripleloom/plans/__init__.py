"""The knowledge graph as tables, and the views that all measurements share."""
