"""Operators for large training corpora. Nothing else in the library imports this
package; its queries and their SQL are registered by ``queries.py``."""
