"""Training-data operators: near-duplicate and repeat removal, search, redaction, packing, mixing.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general
interface; ``queries`` registers the thin ``opN_<name>`` queries over the supplied tables.
"""
