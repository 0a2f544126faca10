"""Corpus group-descriptor analytics on Spark.

Stages: extract (tag, split, annotate, collect modifiers) -> clean -> weighted
log-odds -> similarity and statistics.  Every operator maps DataFrames to a
DataFrame; ``epithet.plans.jobs`` strings them into table-writing jobs.
"""

from epithet.params import Lexicon

__all__ = ["Lexicon"]
