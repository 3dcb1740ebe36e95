"""Table operators: ``DataFrame -> DataFrame`` functions that work with ``df.transform``."""
