"""Graph, grammar and configuration sources, and result sinks."""
