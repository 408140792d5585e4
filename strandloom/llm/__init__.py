"""Training-data operators: extraction, deduplication, filtering, mixing, encoding.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; :mod:`strandloom.llm.queries` wraps them as the
registered ``opN_<name>`` queries.
"""
