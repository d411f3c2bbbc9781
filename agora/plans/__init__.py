"""Compositions of operators: table bindings, whole analyses, the query catalogue."""
