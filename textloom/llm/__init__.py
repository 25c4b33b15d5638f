"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage.  Each operator module has
the general operator and a thin query function; ``queries`` registers them.
"""
