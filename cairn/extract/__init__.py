"""Extractors: table-generating functions over files (path, text). A file that can't be parsed gives no rows."""
