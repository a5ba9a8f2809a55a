"""Wildcard patterns of short literal pieces against lines: one automaton over all pieces, each line scanned once.

For patterns whose pieces are too short to be join keys. The automaton finds every piece in a line; a pattern is a candidate if all
its pieces were found, and fits if they stand in their order, the first and last at the line's ends where no wildcard is. Patterns
are dealt into shards of at most ``SHARD`` characters, each of which is broadcast; the lines are scanned once per shard, so what a
task holds does not grow with the patterns.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Characters of patterns in one broadcast automaton.
SHARD = 2_000_000


class Pieces:
    """An automaton over the pieces of patterns (group, pattern), where ``*`` stands for anything."""

    def __init__(self, patterns: list[tuple[str, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        numbers: dict[str, int] = {}
        self.patterns: list[tuple[str, str, list[int], bool, bool]] = []
        #: Patterns by group and their longest piece: they are looked at where that piece is found. Key -1: no piece at all.
        self.keyed: dict[tuple[str, int], list[int]] = defaultdict(list)
        self.compared = 0
        for at, (group, pattern) in enumerate(patterns):
            pieces = [p for p in pattern.split("*") if p]
            held = [numbers.setdefault(p, len(numbers)) for p in pieces]
            self.patterns.append((group, pattern, held, pattern.startswith("*"), pattern.endswith("*")))
            self.keyed[group, max(held, key=lambda n: len(pieces[held.index(n)])) if held else -1].append(at)
        self.lengths = [0] * len(numbers)
        for piece, n in numbers.items():
            self.automaton.add_word(piece, n)
            self.lengths[n] = len(piece)
        if numbers:
            self.automaton.make_automaton()

    def fitting(self, group: str, line: str) -> list[int]:
        """Numbers of the patterns of the group that fit the whole line."""
        starts: dict[int, list[int]] = defaultdict(list)
        if self.lengths:
            for end, n in self.automaton.iter(line):
                starts[n].append(end + 1 - self.lengths[n])
        found = list(self.keyed.get((group, -1), ()))  # wildcards only
        found = [at for at in found if "*" in self.patterns[at][1] or not line]
        for n in starts:
            for at in self.keyed.get((group, n), ()):
                self.compared += 1
                if self.fits(at, starts, len(line)):
                    found.append(at)
        return found

    def fits(self, at: int, starts: dict[int, list[int]], size: int) -> bool:
        _, pattern, held, free_start, free_end = self.patterns[at]
        if any(n not in starts for n in held):
            return False
        if "*" not in pattern:
            return starts[held[0]][0] == 0 and self.lengths[held[0]] == size
        place, last = 0, len(held) - 1
        for i, n in enumerate(held):
            options = starts[n]
            if i == last and not free_end:
                begin = size - self.lengths[n]
                return begin >= place and options[-1] == begin and (i > 0 or free_start or begin == 0)
            if i == 0 and not free_start:
                if options[0] != 0:
                    return False
                place = self.lengths[n]
                continue
            nxt = bisect_left(options, place)
            if nxt == len(options):
                return False
            place = options[nxt] + self.lengths[n]
        return True


def short_matches(patterns: DataFrame, lines: DataFrame, shard: int = SHARD) -> DataFrame:
    """(category, pattern, line) of ``patterns`` (category, pattern, low) and ``lines`` (category, line, low_line); lower case is compared."""
    asked = staged(patterns.select("category", "pattern", "low"), "short-patterns")
    size = asked.agg(F.sum(F.length("low") + F.length("pattern") + F.length("category"))).first()[0] or 0
    shards = max(1, -(-size * 2 // shard))  # hashing deals unevenly: half full on the average
    # lines of a category without such a pattern are not scanned
    lines = lines.join(staged(asked.select("category").distinct(), "short-categories"), "category", "left_semi")
    columns = ["category", "pattern", "line"]
    found = asked.sparkSession.createDataFrame([], "category string, pattern string, line string")
    for part in range(shards if size else 0):
        rows = asked.where(F.pmod(F.xxhash64("category", "pattern"), F.lit(shards)) == part).collect()
        shared = asked.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            given = shared.value
            pieces = Pieces([(c, low) for c, _, low in given])
            for batch in batches:
                hits = [(c, given[at][1], line) for c, line, low in zip(*(batch.column(i).to_pylist() for i in range(3))) for at in pieces.fitting(c, low)]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.string()) for i in range(3)], names=columns)

        found = found.unionByName(lines.select("category", "line", "low_line").mapInArrow(scan, "category string, pattern string, line string"))
    return found
