"""Registered queries: each operator applied to the retail view, with its check SQL."""
