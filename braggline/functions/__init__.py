"""Column expressions: everything here is narrow and adds no shuffle."""
