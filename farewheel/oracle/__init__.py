"""The same questions in plain SQL, for an independent check of every operator.

The statements join and count rows directly and share no logic with the operators, which
reduce both sides before they join.
"""

from farewheel.oracle.upkeep import oracle_queries

__all__ = ["oracle_queries"]
