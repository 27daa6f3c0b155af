"""The shape of a grid on which every row of one side meets every row of the other."""

from __future__ import annotations

import math


def grid_shape(
    cells: int, left_bytes: float, right_bytes: float, least: tuple[int, int], most: tuple[int, int]
) -> tuple[int, int]:
    """Into how many groups and blocks two sides are cut, for about ``cells`` cells.

    The left side is copied once per block and the right one once per group; the numbers make
    these copies few, and lie between ``least`` and ``most``, of which the former counts.
    """
    wanted = math.sqrt(cells * max(left_bytes, 1.0) / max(right_bytes, 1.0))
    groups = max(least[0], min(most[0], round(wanted)), 1)
    blocks = max(least[1], min(most[1], math.ceil(cells / groups)), 1)
    return groups, blocks
