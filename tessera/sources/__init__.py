from .tables import TABLE_NAMES, read_table, corpus, customer_panel, text_pairs  # noqa: F401
