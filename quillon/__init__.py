"""Quillon: vector retrieval and media-catalogue operators as Spark DataFrame transforms."""
