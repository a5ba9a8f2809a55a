"""Token counts of very long pre-tokens: chunks run side by side from guessed states, checked and composed where they meet.

The last token of the BPE of each prefix is the one vocabulary suffix that is compatible with the last token before it. A long
pre-token is cut into chunks; each chunk starts some bytes early from a fresh state, and all chunks of many pre-tokens advance byte
by byte in one numpy step. A chunk's map is right if, where it begins, its last tokens and relative counts agree with those of the
chunk before at every place from which a token may still be open; the count of the pre-token is then the sum of its chunks' counts.
Pre-tokens whose chunks do not agree are left to the transducer that is compiled state by state (they repeat, so their states do).

Two tokens are compatible if no merge ever crosses their border: x on the right edge of the first lives until its parent is made,
y on the left edge of the second likewise, and the merge of x and y must come before the parent of x and not after that of y (of
equal merges the leftmost goes first).
"""

from __future__ import annotations

import numpy as np

#: Bytes of a chunk, bytes that it starts early, chunks at once, the logarithm of the pairs remembered.
CHUNK, EARLY, AT_ONCE, SLOT_BITS = 96, 32, 8192, 21
NEVER = np.int64(1 << 40)
UNSET, FRESH = -2, -1


class LongWords:
    """Tables of a merge list: products, the edges of their merge trees with the time at which each piece ends, a trie of bytes."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        names: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        left, right = list(range(256)), list(range(256))
        self.usable = True
        for a, b in merges:
            if a not in names or b not in names or a + b in names:
                self.usable = False  # a product of two merges has no time of its own
                return
            left.append(names[a])
            right.append(names[b])
            names[a + b] = len(names)
        self.left, self.right, self.size = np.array(left), np.array(right), len(names)
        self.lengths = np.array([len(t) for t in names], np.int64)
        own = np.arange(256, self.size)
        key = self.left[own] * self.size + self.right[own]
        order = np.argsort(key)
        self.pair_keys, self.pair_times = key[order], own[order]
        self.known_keys, self.known = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        self.build_trie(list(names))
        self.own = self.spells_itself()

    def build_trie(self, tokens: list[bytes]) -> None:
        """Edges (node * 256 + byte) -> node, and the token at a node or -1."""
        node = np.zeros(len(tokens), np.int64)
        keys, targets, ends = [], [], np.full(1, -1, np.int64)
        count, alive, depth = 1, np.arange(len(tokens)), 0
        while len(alive):
            byte = np.array([tokens[i][depth] for i in alive.tolist()], np.int64)
            made, at = np.unique(node[alive] * 256 + byte, return_inverse=True)
            keys.append(made)
            targets.append(count + np.arange(len(made)))
            ends = np.concatenate((ends, np.full(len(made), -1, np.int64)))
            node[alive] = count + at
            count += len(made)
            depth += 1
            done = self.lengths[alive] == depth
            ends[node[alive[done]]] = alive[done]
            alive = alive[~done]
        key, target = np.concatenate(keys), np.concatenate(targets)
        order = np.argsort(key)
        self.edge_keys, self.edge_nodes, self.token_at = key[order], target[order], ends

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
        return np.where(self.edge_keys[at] == key, self.edge_nodes[at], -1)

    def time_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """When the pair is merged, NEVER if it is no merge."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_times[at], NEVER)

    def crosses(self, first: np.ndarray, second: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge crosses the border of two tokens (earlier than ``before``, if that is given)."""
        found = np.zeros(len(first), bool)
        rows, x, x_end = np.arange(len(first)), first.copy(), np.full(len(first), NEVER)
        while len(rows):
            inner, y, y_end = np.arange(len(rows)), second[rows], np.full(len(rows), NEVER)
            while len(inner):
                time = self.time_of(x[inner], y)
                hit = (time < x_end[inner]) & (time <= y_end) & (time < NEVER)
                if before is not None:
                    hit &= time < before[rows[inner]]
                found[rows[inner[hit]]] = True
                deeper = (y >= 256) & ~found[rows[inner]]
                inner, y_end, y = inner[deeper], y[deeper], self.left[y[deeper]]
            deeper = (x >= 256) & ~found[rows]
            rows, x_end, x = rows[deeper], x[deeper], self.right[x[deeper]]
        return found

    def spells_itself(self) -> np.ndarray:
        """Tokens that BPE makes of their own bytes: both halves are such, and nothing crosses between them before they merge."""
        good = np.ones(self.size, bool)
        made = np.arange(256, self.size)
        good[made] = ~self.crosses(self.left[made], self.right[made], made)
        for t in np.flatnonzero(~good).tolist():
            good[t] = False
        changed = True
        while changed:
            after = good.copy()
            after[made] &= good[self.left[made]] & good[self.right[made]]
            changed, good = bool((after != good).any()), after
        return good

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE leaves two tokens as they are. Answers are kept in a table of fixed size, a later pair in place of an earlier."""
        key = first * self.size + second
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        fine, missing = self.known[slot], np.flatnonzero(self.known_keys[slot] != key)
        if len(missing):
            new, at = np.unique(key[missing], return_inverse=True)
            made = ~self.crosses(new // self.size, new % self.size)
            fine[missing] = made[at]
            self.known_keys[slot[missing]] = key[missing]
            self.known[slot[missing]] = made[at]
            # of two new pairs of one slot either may have been written: the slot's answer is that of the pair it holds
            holder = self.known_keys[slot[missing]]
            self.known[slot[missing]] = made[np.searchsorted(new, holder)]
        return fine

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; -1 where its chunks do not agree."""
        out = np.full(len(words), -1, np.int64)
        group, size = [], 0
        for i, w in enumerate(words):
            n = -(-len(w) // CHUNK)
            if group and size + n > AT_ONCE:
                self.run(words, group, out)
                group, size = [], 0
            group.append(i)
            size += n
        if group:
            self.run(words, group, out)
        return out

    def run(self, words: list[bytes], group: list[int], out: np.ndarray) -> None:
        width = EARLY + CHUNK
        parts, sizes, owner, first = [], [], [], []
        for i in group:
            w = words[i]
            for at in range(0, len(w), CHUNK):
                piece = w[max(0, at - EARLY) : at + CHUNK]
                pad = EARLY if at == 0 else 0
                parts.append(b"\0" * pad + piece + b"\0" * (width - pad - len(piece)))
                sizes.append(pad + len(piece))
                owner.append(i)
                first.append(at == 0)
        data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width).astype(np.int64)
        ends, owner, first = np.array(sizes), np.array(owner), np.array(first)
        begin = np.where(first, EARLY, 0)
        rows = len(data)
        chunk, start, stop, token, reach = self.candidates(data, begin, ends)
        last = np.full((rows, width + 1), UNSET, np.int64)
        count = np.zeros((rows, width + 1), np.int64)
        last[np.arange(rows), begin] = FRESH
        order = np.lexsort((-self.lengths[token], chunk, stop))
        chunk, start, stop, token = chunk[order], start[order], stop[order], token[order]
        edges = np.searchsorted(stop, np.arange(width + 2))
        for column in range(1, width + 1):
            lo, hi = edges[column], edges[column + 1]
            c, s, t = chunk[lo:hi], start[lo:hi], token[lo:hi]
            before = last[c, s]
            fine = before == FRESH
            check = np.flatnonzero(before >= 0)
            if len(check):
                fine[check] = self.compatible(before[check], t[check])
            c, s, t = c[fine], s[fine], t[fine]
            longest = np.flatnonzero(np.diff(c, prepend=-1))
            c, s, t = c[longest], s[longest], t[longest]
            last[c, column] = t
            count[c, column] = count[c, s] + 1
        at_end = count[np.arange(rows), ends]
        entry = count[:, EARLY]
        sound = last[np.arange(rows), ends] >= 0
        # where chunk k begins: all places from which a token of the chunk before is still open
        later = np.flatnonzero(~first)
        prior = later - 1
        places = np.arange(CHUNK, width + 1)
        asked = places[None, :] >= np.minimum(reach[prior], width)[:, None]
        mine, theirs = last[later][:, : EARLY + 1], last[prior][:, CHUNK:]
        here = count[later][:, : EARLY + 1] - count[later, EARLY][:, None]
        there = count[prior][:, CHUNK:] - count[prior, width][:, None]
        sound[later] &= (~asked | ((mine == theirs) & (here == there))).all(axis=1) & (reach[prior] >= CHUNK) & (mine[:, EARLY] >= 0)
        total = np.zeros(len(out), np.int64)
        np.add.at(total, owner, at_end - np.where(first, 0, entry))
        bad = np.zeros(len(out), bool)
        np.logical_or.at(bad, owner, ~sound)
        for i in group:
            out[i] = -1 if bad[i] else total[i]

    def candidates(self, data: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, start, stop, token) of every token of a chunk, and the first place whose bytes are open at the chunk's end."""
        width = data.shape[1]
        columns = np.arange(width)
        chunk, start = np.nonzero((columns >= begin[:, None]) & (columns < ends[:, None]))
        node, at = np.zeros(len(chunk), np.int64), start.copy()
        reach = np.full(len(data), width, np.int64)
        found = []
        while len(chunk):
            node = self.child(node, data[chunk, at])
            keep = node >= 0
            chunk, start, node, at = chunk[keep], start[keep], node[keep], at[keep] + 1
            token = self.token_at[node]
            real = token >= 0
            real[real] = self.own[token[real]]
            found.append((chunk[real], start[real], at[real], token[real]))
            over = at >= ends[chunk]
            np.minimum.at(reach, chunk[over], start[over])
            chunk, start, node, at = chunk[~over], start[~over], node[~over], at[~over]
        return (*(np.concatenate(p) for p in zip(*found)), reach)
