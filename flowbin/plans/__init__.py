"""Compositions of operators: labelling, the experiment sweep, named queries."""
