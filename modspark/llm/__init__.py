"""Training-data pipeline operators.  Nothing else in the package imports
this subpackage; ``corpus_pipeline.py`` and ``queries.py`` here use it."""
