"""Jobs and read queries composed from the operators."""
