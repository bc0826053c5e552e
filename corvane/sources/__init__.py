from corvane.sources.tables import optional_table, parse_lines, table  # noqa: F401
