"""Column functions: no job starts here, every result is a Column."""
