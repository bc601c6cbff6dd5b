"""Spark-first analytics: a composable transform algebra, per-series insights and declarative chart specifications."""
