"""Grammars, automata and the rule programs that the engine runs."""
