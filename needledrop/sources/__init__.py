"""Readers, writers and stored tables; import from the submodules."""
