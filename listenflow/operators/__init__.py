"""User-level analyses, each a function ``(ProductTables, **params) -> DataFrame``."""
