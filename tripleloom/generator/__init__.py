"""From a signature to a graph: schema, wiring, rewiring."""
