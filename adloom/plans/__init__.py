"""Compositions of operators that users call as one step."""
