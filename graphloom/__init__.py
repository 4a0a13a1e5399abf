"""graphloom: knowledge-graph, search, drift and event-log analytics as Spark plans."""
