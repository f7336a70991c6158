"""Errors that callers of plan and shape editing meet. [G33, G34]"""

from __future__ import annotations


class PrecinctNotInGroup(ValueError):
    """A precinct was to be taken out of a group that does not hold it."""


#: What columns raise, as ``raise_error`` texts.
RING_OPEN = "ring is not closed"
SEVERAL_PARTS = "a precinct of several parts; split parts first"
