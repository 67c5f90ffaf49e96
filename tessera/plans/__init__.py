"""The fitted index, its result objects and the registered queries."""
