"""Tessera: exact analytics over document collections and the tables in them, as Spark DataFrame transformations."""
