"""Registered queries of the library and the SQL that checks them, one module per family."""
