"""Training-data operators. Nothing outside this subpackage imports it, except the optional hook in ``__spark_entry__``."""
