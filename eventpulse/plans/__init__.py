"""Adaptations of the test tables, the registered queries with their SQL, and the chains of operators."""
