"""Lines that say a parameter's anchor: the best of their windows, by the share of signs that both have in order.

Anchors are a caller's list and go to every task; ``MOST_ANCHORS`` bounds it. An anchor meets all lines of a batch at
once: counts of signs give an upper bound for each window, and only those that can reach the least score are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import fold
from factloom.operators.picks import first_per

MOST_ANCHORS = 10_000
#: Signs compared at once, windows compared at once, and the length of anchors that fit a machine word.
SIGNS, WINDOWS, WORD = 1 << 20, 1 << 15, 64


@lru_cache(maxsize=4096)
def _places(anchor: str) -> dict[str, int]:
    """For each sign of the anchor its places as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(anchor):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(anchor: str, window: str) -> int:
    """Signs that both have in one order: a bit that turns to zero for each (Hyyro, 2004)."""
    places, full = _places(anchor), (1 << len(anchor)) - 1
    rows = full
    for c in window:
        hit = rows & places.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(anchor) - rows.bit_count()


def share(anchor: str, window: str) -> float:
    return 200.0 * common(anchor, window) / (len(anchor) + len(window)) if anchor or window else 100.0


def score(anchor: str, line: str, least: float = 0.0) -> float:
    """100 if the line has the anchor; else the best share of a window as long as the anchor or cut off by an end.

    A line shorter than the anchor counts as a whole. Below ``least`` the score is 0: a window can't share more signs
    than the anchor and the line do without regard to order, which is counted first.
    """
    if not anchor or not line:
        return 0.0
    if anchor in line:
        return 100.0
    shared = sum(min(n, line.count(c)) for c, n in _counts(anchor))
    if 200.0 * shared / (len(anchor) + shared) < least:
        return 0.0
    n, m = len(anchor), len(line)
    if m < n:
        best = share(anchor, line)
    else:
        short = int(least * n / (200.0 - least)) or 1  # a window cut off by an end reaches the least score from here on
        windows = [line[i : i + n] for i in _likely(anchor, line, least)] + [w for i in range(short, n) for w in (line[:i], line[m - i :])]
        best = max((share(anchor, w) for w in windows), default=0.0)
    return best if best >= least else 0.0


def _likely(anchor: str, line: str, least: float) -> list[int]:
    """Where windows as long as the anchor begin that share enough signs with it, whatever their order."""
    codes, n = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4"), len(anchor)
    shared = np.zeros(len(line) - n + 1, np.int64)
    for c, k in _counts(anchor):
        before = np.concatenate([[0], np.cumsum(codes == ord(c))])
        shared += np.minimum(before[n:] - before[:-n], k)
    return np.flatnonzero(100.0 * shared >= least * n - 1e-9).tolist()


@lru_cache(maxsize=4096)
def _counts(anchor: str) -> tuple[tuple[str, int], ...]:
    return tuple((c, anchor.count(c)) for c in sorted(set(anchor)))


class Anchors:
    """Folded anchors of parameters."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = sorted({(param, anchor) for param, anchor in rows if anchor})
        self.signs = np.array(sorted({ord(c) for _, a in self.rows for c in a}), np.uint32)

    def claims(self, lines: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines, anchors and scores from the least on, by line and anchor: a batch of lines at once."""
        text = _Lines(lines, self.signs)
        found = [(*text.best(anchor, least), i) for i, (_, anchor) in enumerate(self.rows)]
        at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        scores = np.concatenate([f[1] for f in found]) if found else np.zeros(0)
        which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        order = np.lexsort((which, at))
        return at[order], which[order], scores[order]

    def rivals(self, least: float) -> list[tuple[str, str]]:
        """Pairs of parameters, both ways round, of which an anchor of one says an anchor of the other."""
        at, which, _ = self.claims([a for _, a in self.rows], least)
        found = {(self.rows[i][0], self.rows[j][0]) for i, j in zip(at.tolist(), which.tolist())}
        return sorted({pair for p, q in found if p != q for pair in ((p, q), (q, p))})


class _Lines:
    """Lines of a batch as one text: how often a sign comes before each place tells what every window has at most."""

    def __init__(self, lines: list[str], signs: np.ndarray):
        self.lines = lines
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        self.sizes = np.array([len(line) for line in lines], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        at = np.minimum(np.searchsorted(signs, codes), max(len(signs) - 1, 0))
        self.sign = np.where(signs[at] == codes, at, len(signs)) if len(signs) else np.zeros(len(codes), np.int64)
        self.places = {c: i for i, c in enumerate(signs.tolist())}
        self.before: dict[int, np.ndarray] = {}

    def _before(self, sign: int) -> np.ndarray:
        """How often the sign comes before each place; only differences of up to 64 places are taken."""
        if sign not in self.before:
            self.before[sign] = np.zeros(len(self.sign) + 1, np.uint8)
            np.cumsum(self.sign == sign, dtype=np.uint8, out=self.before[sign][1:])
        return self.before[sign]

    def best(self, anchor: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Lines whose score for the anchor is the least or more, and the score."""
        n = len(anchor)
        if n > WORD:
            scores = np.array([score(anchor, line, least) for line in self.lines], float)
            lines = np.flatnonzero((self.sizes > 0) & (scores >= least))
            return lines, scores[lines]
        counts = [(self.places[ord(c)], k) for c, k in _counts(anchor)]
        scores, word = np.full(len(self.lines), -1.0), np.zeros(len(self.places) + 1, np.uint64)
        for c, places in _places(anchor).items():
            word[self.places[ord(c)]] = places
        for lines, begin, size in self._windows(n, counts, least):
            for i in range(0, len(lines), WINDOWS):
                part = slice(i, i + WINDOWS)
                shared = self._common(n, word, begin[part], size[part])
                np.maximum.at(scores, lines[part], 200.0 * shared / (n + size[part]))
        lines = np.flatnonzero((scores >= 0) & (scores >= least))
        return lines, scores[lines]

    def _windows(self, n: int, counts: list[tuple[int, int]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Line, begin and size of all windows that share enough signs with the anchor, whatever their order."""
        need = lambda size: least * (n + size) / 200.0 - 1e-9
        if len(self.sign) >= n:
            shared = np.zeros(len(self.sign) - n + 1, np.uint8)
            for c, k in counts:
                before = self._before(c)
                shared += np.minimum(before[n:] - before[:-n], np.uint8(k))
            begin = np.flatnonzero(shared >= need(n))
            lines = np.searchsorted(self.ends, begin, "right")
            inside = begin + n <= self.ends[lines]
            yield lines[inside], begin[inside], np.full(int(inside.sum()), n)
        short = np.flatnonzero((self.sizes > 0) & (self.sizes < n))
        cut = np.flatnonzero(self.sizes >= n)
        sizes = [(short, self.starts[short], self.sizes[short])]
        for size in range(int(least * n / (200.0 - least)) or 1, n):  # a window cut off by an end reaches the least score from here on
            sizes += [(cut, begin, np.full(len(cut), size)) for begin in (self.starts[cut], self.ends[cut] - size)]
        for lines, begin, size in sizes:
            shared = np.zeros(len(lines), np.int64)
            for c, k in counts:
                before = self._before(c)
                shared += np.minimum(before[begin + size] - before[begin], np.uint8(k))
            kept = shared >= need(size)
            yield lines[kept], begin[kept], size[kept]

    def _common(self, n: int, word: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``common`` of the anchor and many windows at once, a machine word for each."""
        full = np.uint64((1 << n) - 1)
        rows = np.full(len(begin), full)
        for t in range(int(size.max()) if len(size) else 0):
            hit = rows & np.where(t < size, word[self.sign[np.minimum(begin + t, len(self.sign) - 1)]], np.uint64(0))
            rows = (rows + hit | rows - hit) & full
        return n - np.bitwise_count(rows).astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring lines of ``SIGNS`` signs together, or a single longer one, with the place of the first."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SIGNS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def _known(anchors: DataFrame) -> Anchors:
    rows = anchors.where("anchor is not null").select("param", fold(F.col("anchor")).alias("anchor")).limit(MOST_ANCHORS + 1).collect()
    if len(rows) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    return Anchors([tuple(r) for r in rows])


def _claimed(lines: DataFrame, known: Anchors, keys: list[str], least: float, rivals: list[tuple[str, str]] = ()) -> DataFrame:
    """Claims of the lines without those that a rival of the param has a better one against; all of a line are in one task."""
    params = sorted({p for p, _ in known.rows})
    number = {p: i for i, p in enumerate(params)}
    param = np.array([number[p] for p, _ in known.rows], np.int64)
    size = np.array([len(a) for _, a in known.rows], np.int64)
    against: dict[int, list[int]] = {}
    for p, q in rivals:
        against.setdefault(number[p], []).append(number[q])

    def claimed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, texts in _pieces(frame["_text"].tolist()):
                at, which, scores = known.claims(texts, least)
                order = np.lexsort((-size[which], -scores, param[which], at))
                at, which, scores = at[order], which[order], scores[order]
                best = np.ones(len(at), bool)
                best[1:] = (at[1:] != at[:-1]) | (param[which][1:] != param[which][:-1])
                at, which, scores = at[best], which[best], scores[best]
                if against:
                    claims = {(a, p): (s, n) for a, p, s, n in zip(at.tolist(), param[which].tolist(), scores.tolist(), size[which].tolist())}
                    kept = np.array([all(claims.get((a, q), (-1.0, 0)) <= claim for q in against.get(p, ())) for (a, p), claim in claims.items()], bool)
                    at, which, scores = at[kept], which[kept], scores[kept]
                if not len(at):
                    continue
                found = frame.drop(columns="_text").iloc[first + at].reset_index(drop=True)
                yield found.assign(param=[params[i] for i in param[which].tolist()], score=scores, size=size[which])

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in [*keys, "no"])
    folded = lines.where("text is not null").select(*keys, "no", fold(F.col("text")).alias("_text"))
    return folded.mapInPandas(claimed, f"{kinds}, param string, score double, size int")


def anchor_claims(lines: DataFrame, anchors: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, no, param, score and size of all lines (text) that reach the least score for an anchor of a param.

    ``anchors`` (param, anchor) are folded like the lines. Null texts and anchors say nothing.
    """
    return _claimed(lines, _known(anchors), keys, least)


def best_lines(lines: DataFrame, anchors: DataFrame, keys: list[str], least: float = 85.0) -> DataFrame:
    """keys, param, no and score of the line that says each parameter best, the first of equals.

    A line that a rival claims better, by score and then by the longer anchor, isn't the parameter's.
    """
    known = _known(anchors)
    claims = _claimed(lines, known, keys, least, known.rivals(least))
    return first_per(claims, [*keys, "param"], [F.desc("score"), F.asc("no")]).select(*keys, "param", "no", "score")
