"""Rules of a few tokens against sets of many: which rules have a set of another side with enough of their tokens.

Sets are dealt evenly into blocks, and every block tries all rules on an index of its own from tokens to sets. A set with ``need``
of n tokens has two of any n - need + 2, so a rule counts the sets of its rarest ones in the block, as integers, and only a set that
comes twice is looked at for all tokens. No pair of a rule and a set leaves its task; a task holds one block and one batch of rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of sets in a block at most; rules of a task at most; rules looked up at once.
BLOCK, PART, BATCH = 1 << 24, 1 << 22, 1 << 18
#: Tokens of sets for which another block is worth it, while there are fewer blocks than tasks that run side by side, twice.
SMALL = 1 << 19
#: Places of sets that are expanded at once.
EXPANDED = 1 << 21
LOW = (1 << 32) - 1


class Block:
    """Sets by token: places are a token's number and a set's, sorted. Sets of a side have numbers in a row."""

    def __init__(self, sets: list[tuple[pa.Array, pa.DictionaryArray, np.ndarray]]):
        """Of sides, tokens in a row and numbers of tokens."""
        side = pa.chunked_array([s for s, _, _ in sets], pa.string()).combine_chunks().dictionary_encode()
        self.sides, code = side.dictionary, side.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.bounds = np.searchsorted(code[order], np.arange(len(self.sides) + 1))
        held = pa.chunked_array([t for _, t, _ in sets], pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
        self.tokens = held.chunk(0).dictionary if held.num_chunks else pa.array([], pa.string())
        self.places = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in held.chunks] or [[]]).astype(np.int64)
        self.places <<= 32
        self.places |= np.repeat(number, np.concatenate([n for _, _, n in sets] or [[]]).astype(np.int64))
        self.places.sort()
        self.starts = np.searchsorted(self.places, np.arange(len(self.tokens) + 1) << 32)
        #: Places that rules were counted on, and sets that were looked at for all tokens of a rule.
        self.counted = self.compared = 0

    def at(self, wanted: np.ndarray) -> np.ndarray:
        """Where places stand or would stand: in their order, as a search near the last one is in the CPU's cache."""
        order, found = np.argsort(wanted), np.empty(len(wanted), np.int64)
        found[order] = np.searchsorted(self.places, wanted[order])
        return found

    def hits(self, imports: pa.Array, own: pa.Array, need: np.ndarray, tried: tuple[int, ...]) -> np.ndarray:
        """Which rules a set of another side hits. One hit is enough: ``tried`` of a token's sets come first, then all."""
        sizes = imports.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = np.zeros(len(sizes), bool)
        token = pc.fill_null(pc.index_in(imports.flatten(), value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rule = np.repeat(np.arange(len(sizes)), sizes)
        here = (token >= 0) & (np.bincount(rule[token >= 0], minlength=len(sizes)) >= need)[rule]
        rule, token = rule[here], token[here]
        side = pc.fill_null(pc.index_in(own, value_set=self.sides), -1).to_numpy(zero_copy_only=False)[rule]
        first, last = self.starts[token], self.starts[token + 1]
        # a rule's own side is a stretch of each token's sets, which is left out
        left = np.where(side < 0, first, self.at(token << 32 | self.bounds[side]))
        right = np.where(side < 0, first, self.at(token << 32 | self.bounds[side + 1]))
        n = (left - first) + (last - right)
        seen = n > 0
        kept = seen & (np.bincount(rule[seen], minlength=len(sizes)) >= need)[rule]
        rule, token, first, left, right, n = (a[kept] for a in (rule, token, first, left, right, n))
        order = np.lexsort((n, rule))
        rule, token, first, left, right, n = (a[order] for a in (rule, token, first, left, right, n))
        # tokens that the block does not have are the rarest
        rank = np.arange(len(rule)) - np.searchsorted(rule, rule) + (sizes - np.bincount(rule, minlength=len(sizes)))[rule]
        rare = np.flatnonzero(rank < (sizes - need + 2)[rule])
        of = np.searchsorted(rule, np.arange(len(sizes) + 1))
        above = 0
        for limit in (*tried, None):
            more = np.zeros(len(sizes), bool)
            more[rule[rare[n[rare] > above]]] = True
            rare = rare[(more & ~found)[rule[rare]]]
            take = n[rare] if limit is None else np.minimum(n[rare], limit)
            # whole rules are expanded together, as many as fit
            total = np.cumsum(np.bincount(rule[rare], weights=take, minlength=len(sizes)).astype(np.int64))
            chunk = (total // EXPANDED)[rule[rare]]
            for part in np.split(np.arange(len(rare)), np.flatnonzero(np.diff(chunk)) + 1):
                self._count(rule, token, first, left, right, rare[part], take[part], of, need, found)
            above = limit
        return found

    def _count(self, rule, token, first, left, right, rare, take, of, need, found) -> None:
        before = np.minimum(take, left[rare] - first[rare])
        begin, length = np.stack([first[rare], right[rare]], 1).ravel(), np.stack([before, take - before], 1).ravel()
        at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        pair = np.repeat(rule[rare], take) << 32
        pair |= self.places[at] & LOW
        pair.sort()
        twice = pair[1:][pair[1:] == pair[:-1]]
        twice = twice[np.diff(twice, prepend=-1) != 0]
        self.counted, self.compared = self.counted + len(pair), self.compared + len(twice)
        held = twice >> 32
        n = of[held + 1] - of[held]
        which = np.repeat(np.arange(len(twice)), n)
        wanted = token[np.repeat(of[held] - (np.cumsum(n) - n), n) + np.arange(len(which))] << 32 | (twice & LOW)[which]
        place = np.minimum(self.at(wanted), max(len(self.places) - 1, 0))
        enough = np.bincount(which[self.places[place] == wanted], minlength=len(twice)) >= need[held]
        found[held[enough]] = True


def hit_rules(rules: DataFrame, sets: DataFrame, tried: tuple[int, ...]) -> DataFrame:
    """(rule) of the rules (rule, own, imports, need) that a set (run_id, side, tokens, n) of n tokens and another side has ``need`` imports of, two at least."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK), min(total // SMALL, 2 * sets.sparkSession.sparkContext.defaultParallelism))
    parts = max(1, -(-rules.count() // PART))
    batch_of = BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, waiting, block = [], [], None

        def flushed() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            whole = table.to_batches()[0]
            hit = block.hits(whole["tokens"], whole["side"], whole["need"].to_numpy(zero_copy_only=False), tried)
            return pa.RecordBatch.from_arrays([whole["rule"].filter(pa.array(hit))], names=["rule"])

        for batch in batches:  # sets come before rules
            n = pc.sum(pc.less(batch["rule"], 0)).as_py() or 0
            if n:
                tokens = batch["tokens"].slice(0, n)
                sets.append((pc.cast(batch["side"].slice(0, n), pa.string()), tokens.flatten().dictionary_encode(), tokens.value_lengths().to_numpy(zero_copy_only=False)))
            if n < batch.num_rows:
                if block is None:
                    block = Block(sets)
                    sets.clear()
                waiting.append(batch.slice(n))
                if sum(b.num_rows for b in waiting) >= batch_of:
                    yield flushed()
        if waiting:
            yield flushed()

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block, part = F.pmod(F.xxhash64("run_id", "side"), F.lit(blocks)), F.pmod(F.col("rule"), F.lit(parts))
    dealt = sets.where("n >= 2").select(block.alias("block"), every(parts).alias("part"), F.lit(-1).cast("long").alias("rule"), "side", "tokens", F.lit(0).alias("need"))
    dealt = dealt.unionByName(rules.select(every(blocks).alias("block"), part.alias("part"), "rule", F.col("own").alias("side"), F.col("imports").alias("tokens"), "need"))
    task = (F.col("block") * parts + F.col("part")).cast("int")
    return dealt.repartitionById(blocks * parts, task).sortWithinPartitions("rule").select("rule", "side", "tokens", "need").mapInArrow(run, "rule long").distinct()
