"""Edit distance of many pairs of word sequences at once, in a band no wider than allowed.

The furthest-reaching form of the banded alignment: for e edits and each diagonal of the band, how far the first e edits
can get; runs of equal words are skipped by hashes of blocks of 1, 2, 4, ... words. So a pair costs about the square of its own distance, not the
product of its lengths. Before that, common ends are cut off and pairs whose words alone differ too much are dropped.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of the sequences that are aligned together.
TOGETHER = 60_000


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    start = int(differ.argmax()) if differ.any() else n
    a, b = a[start:], b[start:]
    n -= start
    if n:
        differ = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
        end = int(differ.argmax()) if differ.any() else n
        a, b = a[: len(a) - end], b[: len(b) - end]
    return a, b


def _least(a: np.ndarray, b: np.ndarray) -> int:
    """No alignment has fewer edits: the longer one's words that the other lacks."""
    at = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    m = int(at.max()) + 1
    return max(len(a), len(b)) - int(np.minimum(np.bincount(at[: len(a)], minlength=m), np.bincount(at[len(a) :], minlength=m)).sum())


def _blocks(rows: list[np.ndarray], width: int, pad: int) -> list[np.ndarray]:
    """Hashes of the 2**j words from each place on; what is past the end equals nothing of the other side."""
    first = np.full((len(rows), width + 1), np.uint64(pad) << np.uint64(40), np.uint64)
    for i, r in enumerate(rows):
        first[i, : len(r)] = r
    out, size = [first.ravel()], 1
    while 2 * size <= width:
        h = out[-1].reshape(len(rows), width + 1)
        nxt = h * _MIX
        nxt ^= nxt >> np.uint64(29)
        nxt[:, :-size] += h[:, size:]
        nxt[:, -size:] += np.uint64(pad) << np.uint64(41)
        nxt *= _MIX
        nxt ^= nxt >> np.uint64(32)
        out.append(nxt.ravel())
        size *= 2
    return out


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Whether each pair (a, b, edits allowed) is within its edits."""
    ok = np.zeros(len(pairs), bool)
    la, lb, most = (np.array(x) for x in zip(*((len(a), len(b), k) for a, b, k in pairs), strict=True))
    width, band = int(max(la.max(), lb.max())), int(most.max())
    with np.errstate(over="ignore"):
        one, other = _blocks([p[0] for p in pairs], width, 1), _blocks([p[1] for p in pairs], width, 2)
    live = np.arange(len(pairs))
    far = np.full((len(pairs), 2 * band + 3), -(1 << 30), np.int64)  # column band + 1 + k: diagonal k, words of a minus words of b
    for e in range(band + 1):
        lo, hi = band + 1 - e, band + 2 + e
        if e:
            x = far[:, lo:hi] + 1
            np.maximum(x, far[:, lo - 1 : hi - 1] + 1, out=x)
            np.maximum(x, far[:, lo + 1 : hi + 1], out=x)
        else:
            x = np.zeros((len(live), 1), np.int64)
        k = np.arange(lo, hi) - band - 1
        np.minimum(x, la[live, None], out=x)
        np.minimum(x, lb[live, None] + k, out=x)
        good = (x >= 0) & (x >= k)
        row = (live * (width + 1))[:, None]
        at = np.flatnonzero(good & (one[0][row + np.where(good, x, 0)] == other[0][row + np.where(good, x - k, 0)]))
        if len(at):
            i, j = np.divmod(at, hi - lo)
            base, px = row[i, 0], x.ravel()[at]
            py = px - k[j]
            for step in range(len(one) - 1, -1, -1):
                fit = (px + (1 << step) <= la[live[i]]) & (py + (1 << step) <= lb[live[i]])
                same = fit & (one[step][base + np.where(fit, px, 0)] == other[step][base + np.where(fit, py, 0)])
                px += same << step
                py += same << step
            x.ravel()[at] = px
        far[:, lo:hi] = np.where(good, x, -(1 << 30))
        through = far[np.arange(len(live)), band + 1 + np.clip((la - lb)[live], -band - 1, band + 1)] >= la[live]
        ok[live[through]] = True
        stay = ~through & (most[live] > e)
        if not stay.all():
            live, far = live[stay], far[stay]
            if not len(live):
                break
    return ok


def within(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Whether the edit distance of each pair (a, b: unsigned 32-bit codes of words; edits allowed) is no more than allowed."""
    ok = np.zeros(len(pairs), bool)
    hard: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for i, (a, b, most) in enumerate(pairs):
        if abs(len(a) - len(b)) > most:
            continue
        a, b = _trimmed(a, b)
        if max(len(a), len(b)) <= most:
            ok[i] = True
        elif len(a) and len(b) and _least(a, b) <= most:
            hard.append((i, a, b, most))
    hard.sort(key=lambda h: (h[3], max(len(h[1]), len(h[2]))))
    group: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    longest = 0
    for h in [*hard, None]:
        longest = max(longest, len(h[1]), len(h[2])) if h else longest
        if group and (h is None or (len(group) + 1) * longest > TOGETHER or h[3] > 2 * group[0][3] + 4):
            ok[[g[0] for g in group]] = _aligned([g[1:] for g in group])
            group, longest = [], max(len(h[1]), len(h[2])) if h else 0
        if h:
            group.append(h)
    return ok
