"""A package, so that test modules here may share names with those one folder up."""
