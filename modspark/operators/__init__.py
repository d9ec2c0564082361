"""DataFrame -> DataFrame operators (chain with ``DataFrame.transform``)."""
