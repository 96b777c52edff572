"""shotbank: a Spark-native knowledge base of worked examples.

Clean raw question / rationale / answer records, embed them, search them
exactly or through IVF cells, render retrieved examples into prompts, run a
pluggable generator over whole query tables and evaluate the results - all as
DataFrame jobs.
"""

__version__ = "0.1.0"
