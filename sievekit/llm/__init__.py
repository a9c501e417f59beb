"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Each operator has its own
module with a general interface; ``queries`` holds the registered digests
``opN_<name>`` and their DuckDB SQL.
"""
