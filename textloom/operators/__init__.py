"""Operators of the studies: design, context, judging, parsing, consensus, order."""
