"""Training-data operators: media, archives, search, packing, scoring, mixing, filtering.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin queries the
entry module registers; every operator has its own module with a general interface.
"""
