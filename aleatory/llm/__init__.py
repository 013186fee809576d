"""Training-data operators: mixing, cleaning, scoring, searching and de-duplicating documents.

Nothing outside this subpackage imports it.
"""
