"""Datasets: quad tables, and tables mapped to virtual RDF; readers and writers."""
