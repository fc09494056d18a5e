"""Seeded query generation on the driver: a few dozen queries, drawn from the collection's statistics."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

Window = tuple[float, float, float, float]


@dataclass(frozen=True)
class Source:
    """What queries are drawn from: the extent, its dense points, the most frequent words, and the vocabulary in order.

    The vocabulary need not be on the driver: it has ``size`` words, and ``words`` looks up those of given places.
    """

    box: Window
    dense_points: list[tuple[float, float]]
    top_words: list[str]
    size: int
    words: Callable[[list[int]], dict[int, str]]

    @classmethod
    def of(cls, box: Window, dense_points: list[tuple[float, float]], top_words: list[str], vocabulary: list[str]) -> Source:
        return cls(box, dense_points, top_words, len(vocabulary), lambda places: {i: vocabulary[i] for i in places})


def area_fraction(area: float) -> float:
    """Values up to 1 are fractions, larger ones percent."""
    return area if area <= 1 else area / 100


def query_window(box: Window, center: tuple[float, float], area: float) -> Window:
    """A window of that share of the box around the centre, shifted to lie within the box."""
    side = area_fraction(area) ** 0.5
    w, h = (box[2] - box[0]) * side, (box[3] - box[1]) * side
    x = min(max(center[0] - w / 2, box[0]), box[2] - w)
    y = min(max(center[1] - h / 2, box[1]), box[3] - h)
    return x, y, x + w, y + h


def clipped_window(box: Window, center: tuple[float, float], area: float) -> Window:
    """The same, cut at the border of the box instead."""
    side = area_fraction(area) ** 0.5
    w, h = (box[2] - box[0]) * side, (box[3] - box[1]) * side
    return max(center[0] - w / 2, box[0]), max(center[1] - h / 2, box[1]), min(center[0] + w / 2, box[2]), min(center[1] + h / 2, box[3])


class Generator:
    def __init__(self, source: Source, seed: int = 1):
        self.source, self.random = source, random.Random(seed)

    def draw(self, n: int, space_percent: float, leading: int = 1) -> tuple[list[str], list[int], int]:
        """``leading`` of the top words, places in a window of the vocabulary for the rest (some to spare), and how many words it takes."""
        size = self.source.size
        width = min(size, max(n, int(size * space_percent / 100)))
        start = self.random.randrange(size - width + 1)
        out = self.random.sample(self.source.top_words, min(leading, n, len(self.source.top_words)))
        return out, self.random.sample(range(start, start + width), min(width, n)), n

    def filled(self, drawn: list[tuple[list[str], list[int], int]]) -> list[list[str]]:
        """The words of several draws, all different within one; the vocabulary is asked once."""
        known = self.source.words(sorted({p for _, places, _ in drawn for p in places}))
        return [(top + [w for p in places if (w := known[p]) not in top])[:n] for top, places, n in drawn]

    def keywords(self, n: int, space_percent: float, leading: int = 1) -> list[str]:
        return self.filled([self.draw(n, space_percent, leading)])[0]

    def weights(self, n: int, low: float = 0.5, high: float = 1.0) -> list[float]:
        """Uniform draws that are scaled to add up to 1."""
        raw = [self.random.uniform(low, high) for _ in range(n)]
        return [r / sum(raw) for r in raw]

    def place(self, window: Window) -> tuple[float, float]:
        return self.random.uniform(window[0], window[2]), self.random.uniform(window[1], window[3])

    def _weighted(self, rows: list[dict], drawn: list) -> list[dict]:
        for row, words in zip(rows, self.filled(drawn), strict=True):
            row["keywords"] = list(zip(words, self.weights(len(words)), strict=True))
        return rows

    def single(self, count: int, keywords: int, area: float, space_percent: float) -> list[dict]:
        """Queries for the boolean and ranking operators, around dense points."""
        rows, drawn = [], []
        for qid in range(count):
            x, y = self.place(query_window(self.source.box, self.random.choice(self.source.dense_points), area))
            drawn.append(self.draw(keywords, space_percent))
            rows.append({"qid": qid, "weight": 1.0, "x": x, "y": y})
        return self._weighted(rows, drawn)

    def groups(self, count: int, size: int, keywords: int, area: float, space_percent: float, subgroup_percent: int | None = None) -> list[dict]:
        """Groups of member queries near one another: weight 1/size each, or 1 for subgroup queries."""
        rows, drawn = [], []
        for gid in range(count):
            window = query_window(self.source.box, self.random.choice(self.source.dense_points), area)
            for m in range(size):
                drawn.append(self.draw(keywords, space_percent))
                x, y = self.place(window)
                rows.append({"gid": gid, "qid": gid * size + m, "weight": 1.0 / size if subgroup_percent is None else 1.0, "x": x, "y": y})
        return self._weighted(rows, drawn)

    def joins(self, count: int, keywords: int, area: float, space_percent: float, dense: bool = True, overlap: float = 0.3) -> list[dict]:
        """Keywords with a share of common ones (weights 0.7 to 1, the others 0.3 to 0.7) and a window."""
        rows, drawn = [], []
        for qid in range(count):
            drawn.append(self.draw(keywords, space_percent, leading=max(1, round(keywords * overlap))))
            if dense:
                window = query_window(self.source.box, self.random.choice(self.source.dense_points), area)
            else:
                window = clipped_window(self.source.box, self.place(self.source.box), area)
            rows.append({"qid": qid, "window": window})
        for row, words in zip(rows, self.filled(drawn), strict=True):
            row["keywords"] = [(w, self.random.uniform(0.7, 1.0) if w in self.source.top_words else self.random.uniform(0.3, 0.7)) for w in words]
        return rows


def subgroup_size(size: int, percent: int) -> int:
    return int(size * percent / 100)
