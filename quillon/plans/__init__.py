"""Registered queries: an operator applied to whole tables, with the same result in DuckDB SQL."""
