"""Migration and analysis of CMS content exports on Spark."""
