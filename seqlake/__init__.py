"""seqlake: sequence-corpus preparation, tokenisation, taxonomy, embedding tables and probe
evaluation as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) and is written with Spark's own
expressions, joins, windows and aggregates; Python runs only inside Arrow-batched helpers where no
built-in expression exists (Unicode normalisation, string similarity, the user's model, small
per-group fits).
"""

__version__ = "0.1.0"
