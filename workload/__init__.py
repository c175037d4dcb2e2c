"""The library's queries on the driver's tables, and the SQL they are checked against."""
