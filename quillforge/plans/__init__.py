"""Bindings of the supplied tables to the engine's tables, the registered queries and their oracles."""
