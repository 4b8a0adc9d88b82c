"""The order in which boxes of a page are read from right to left, as sweeps over arrays.

A page falls into bands with clear space between them. A band of several rows falls into two blocks at its widest upright
gap, if that gap is wide enough and the blocks stand beside each other; the right block is read first, and each block is
taken for itself. Otherwise its rows are read one by one, each from the right.
"""

from __future__ import annotations

import numpy as np

# fixed values: space between bands, as pixels and as a share of the lowest box above it
BAND_GAP, BAND_SHARE = 24, 0.7
# fixed values: of a row's first box, the share of the shorter height that must overlap, and how far down another may start
ROW_OVERLAP, ROW_STEP, ROW_SHARE = 0.5, 12, 0.65
# fixed values: the least upright gap, as pixels, in median widths and as a share of the band's width
GAP, GAP_WIDTHS, GAP_SHARE = 24, 1.5, 0.18
# fixed values: the gap that a box on its own needs, in median widths or as a share of the band's width
LONE_WIDTHS, LONE_SHARE = 2, 0.42


def downwards(boxes: np.ndarray) -> np.ndarray:
    """Places of the boxes (x, y, right, bottom, idx) from the top; of those as high the taller, then the right one."""
    x, y, right, bottom, idx = boxes.T
    return np.lexsort((idx, -right, -bottom, y))


def bands(boxes: np.ndarray) -> list[np.ndarray]:
    """Boxes, sorted downwards, cut where one starts far enough below all before it. The lowest end so far is a running
    maximum; no box above a cut reaches below it, so one sweep serves all bands."""
    low = np.maximum.accumulate(boxes[:, 3])
    lowest = np.flatnonzero(np.r_[True, low[1:] > low[:-1]])  # boxes that were the lowest at their turn
    holder = boxes[lowest[np.searchsorted(lowest, np.arange(len(boxes)), "right") - 1]]
    space = boxes[1:, 1] - low[:-1]
    cuts = np.flatnonzero(space > np.maximum(BAND_GAP, BAND_SHARE * (holder[:, 3] - holder[:, 1])[:-1])) + 1
    return np.split(boxes, cuts)


def rows(band: np.ndarray) -> list[np.ndarray]:
    """A band, sorted downwards, cut before the first box that does not stand beside the first one of its row."""
    cuts, start = [], 0
    height = band[:, 3] - band[:, 1]
    while start < len(band):
        rest = band[start + 1 :]
        short = np.minimum(height[start], height[start + 1 :])
        overlap = np.minimum(band[start, 3], rest[:, 3]) - rest[:, 1]
        beside = (overlap >= ROW_OVERLAP * short) & (rest[:, 1] - band[start, 1] <= np.maximum(ROW_STEP, ROW_SHARE * short))
        start += 1 + (int(np.argmin(beside)) if not beside.all() else len(rest))
        cuts.append(start)
    return np.split(band, cuts[:-1])


def split_at(across: np.ndarray, lines: list[np.ndarray]) -> int:
    """The number of boxes, sorted by x, left of the widest gap that makes two blocks; 0 without one. All gaps are judged
    at once, by what lies before and behind them."""
    n = len(across)
    x, top, right, bottom = across[:, 0], across[:, 1], across[:, 2], across[:, 3]
    whole, width = right.max() - x[0], np.median(right - x)
    gap = x[1:] - np.maximum.accumulate(right)[:-1]
    alone = np.minimum(np.arange(1, n), np.arange(n - 1, 0, -1)) == 1
    wide = gap >= np.where(alone, max(GAP, GAP_WIDTHS * width, GAP_SHARE * whole, min(LONE_WIDTHS * width, LONE_SHARE * whole)), max(GAP, GAP_WIDTHS * width, GAP_SHARE * whole))
    before = np.minimum.accumulate(top)[:-1], np.maximum.accumulate(bottom)[:-1]
    behind = np.minimum.accumulate(top[::-1])[::-1][1:], np.maximum.accumulate(bottom[::-1])[::-1][1:]
    common = np.minimum(before[1], behind[1]) - np.maximum(before[0], behind[0])
    level = 2 * common >= np.minimum(before[1] - before[0], behind[1] - behind[0])
    # where every row has boxes on both sides, the rows are read across
    ends = np.array([(line[:, 0].min(), line[:, 0].max()) for line in lines])
    crossed = ((ends[:, :1] < x[1:]) & (x[1:] <= ends[:, 1:])).all(0)
    good = wide & level & ~crossed
    return int(np.argmax(np.where(good, gap, -1))) + 1 if good.any() else 0


def right_to_left_order(boxes: np.ndarray) -> np.ndarray:
    """The idx of the boxes (x, y, right, bottom, idx) in reading order."""
    out, todo = [], [boxes]
    while todo:
        some = todo.pop()
        found = bands(some[downwards(some)])
        if len(found) > 1:
            todo += found[::-1]
            continue
        lines = rows(found[0])
        across = some[np.lexsort((some[:, 4], some[:, 2], some[:, 0]))]
        at = split_at(across, lines) if len(lines) > 1 else 0
        if at:
            todo += [across[:at], across[at:]]
        else:
            out += [line[np.lexsort((line[:, 4], line[:, 1], -line[:, 2])), 4] for line in lines]
    return np.concatenate(out)
