"""Training-data operators: one module per operator, each usable on its own.

Nothing outside this folder imports it, so it can be removed whole.
"""
