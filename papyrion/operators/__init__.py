"""Set-level operators: each takes DataFrames and returns a DataFrame.

Those whose later steps depend on what earlier ones found (schema changes, orphan references) run these earlier
steps as jobs when they are called, and say so; the rest is lazy.
"""
