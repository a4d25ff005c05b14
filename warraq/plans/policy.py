"""Settings of the page search."""

from __future__ import annotations

from dataclasses import dataclass

#: Characters that a window may skip at a page break, and edits that a break may cost more.
SEAM_GAP, SEAM_BONUS = 200, 80


@dataclass(frozen=True)
class MatchPolicy:
    """``enable_fuzzy``: search approximately what is not found exactly. ``q``: length of grams. The others bound the work and the edits of an excerpt."""

    enable_fuzzy: bool = True
    grams_per_excerpt: int = 5
    max_candidates_per_excerpt: int = 40
    max_edit_abs: int = 3
    max_edit_rel: float = 0.1
    q: int = 4
    seam_len: int = 512


DEFAULT_POLICY = MatchPolicy()
