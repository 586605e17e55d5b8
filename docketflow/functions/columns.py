"""Building large column expressions once."""

from __future__ import annotations

from functools import cache

# A Column is an immutable, unresolved description.  Builders whose arguments are
# constants are cached, because describing a rule bank takes far longer on the
# driver than using the description in another plan.
fixed_column = cache
