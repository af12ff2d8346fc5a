"""listenflow: freemium conversion analytics as Spark DataFrame jobs.

Every analysis is a plain function ``f(tables, **params) -> DataFrame`` where
``tables`` is a :class:`listenflow.sources.product.ProductTables`.  Nothing is
collected to the driver; results are lazy DataFrames.
"""

from listenflow.session import build_session, checkpoint_dir
from listenflow.sources.product import ProductTables, load_product_tables

__all__ = ["build_session", "checkpoint_dir", "ProductTables", "load_product_tables"]
