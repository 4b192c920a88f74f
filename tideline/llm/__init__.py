"""Operators for large training-data pipelines (see the README's table).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it
can be imported.
"""
