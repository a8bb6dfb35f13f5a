"""Spark jobs for auditing AI assistants: tables of turns in, tables of findings and decisions out."""
