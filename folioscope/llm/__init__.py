"""Operators for preparing training data, with their queries and SQL (``registry``).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries where it is
there.
"""
