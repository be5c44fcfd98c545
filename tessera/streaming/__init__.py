from .clean_stream import row_features, start_cleaning_stream  # noqa: F401
