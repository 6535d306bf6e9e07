"""Column functions: Column in, Column out, no DataFrame state."""
