"""convspark: a PySpark engine for counseling-dialogue corpora.

Turn rows ``(conv_id, turn, role, text)`` are the central relation.  Every
operator is a plain function ``DataFrame -> DataFrame`` (or a Column
expression) built from Spark SQL built-ins; Python runs only for the
pluggable model callables, the tokenizer, Unicode NFKD and stream state.
"""

__version__ = "0.1.0"
