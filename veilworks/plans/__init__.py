"""Query plans over the library's operators."""
