"""The library's queries on the TPC-H-like test tables, with SQL to check them."""
