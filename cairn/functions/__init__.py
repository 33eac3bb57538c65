"""Column expressions: guards, predicates and text helpers."""
