"""The registered queries: inventories derived from the given tables, and what is asked of them."""
