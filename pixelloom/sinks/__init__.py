"""Where catalogues and results are written."""
