"""Training-data operators: one module each; queries.py applies them to whole tables."""
