"""Training-data operators over the ``documents`` table (see each module)."""
