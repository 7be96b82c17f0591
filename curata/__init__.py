"""Curation of structured language-model data as Spark plans."""
