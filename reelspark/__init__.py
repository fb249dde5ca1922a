"""reelspark: set-at-a-time Spark operators for media catalogues, viewing data and text corpora."""
