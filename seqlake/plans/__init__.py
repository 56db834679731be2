"""Registered queries: each is a Spark job over the driver tables plus, where SQL can say the
same, the equivalent DuckDB statement used as the correctness oracle."""
from seqlake.plans.registry import QUERIES, SQL, register  # noqa: F401
from seqlake.plans import corpus, tokens, species, taxonomy, vectors, evaluation  # noqa: F401,E402
