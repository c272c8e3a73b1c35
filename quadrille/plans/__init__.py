"""SPARQL text to algebra to DataFrame plans."""
