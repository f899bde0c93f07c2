"""End-to-end compositions: table builds and the queries a user calls."""
