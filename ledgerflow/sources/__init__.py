"""Sources: file selection, CSV, Excel and JDBC."""
