"""Reading and writing tables, files, streams and JDBC."""
