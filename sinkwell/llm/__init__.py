"""Training-data operators: language ID, decontamination, dedup, search, sharding, counting, formatting, mixing.

Nothing outside this package imports it.  Each module holds one operator with a general interface;
``queries.py`` derives the thin digest queries from them.
"""
