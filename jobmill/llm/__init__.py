"""Training-data operators: cleaning, de-duplication, scoring, formatting and packing.

One module per operator, ``queries.py`` registers them. Nothing outside this
subpackage (but the entry points at the repository top) imports it.
"""
