"""Byte-level BPE of many distinct words at once: each round merges the best pair of every word."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int64(1) << np.int64(30)


class MergeTable:
    """Ranked merges of pairs of token ids, in two open hash tables without probing."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray, byte_ids: np.ndarray):
        """``pairs``: rows (left id, right id); ``ranks``: theirs; ``merged``: new id by rank."""
        self.byte_ids = byte_ids
        keys = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1].astype(np.uint64)
        self._merged = merged.astype(np.int64)
        self._levels = []
        left = np.arange(len(keys))
        bits = 20
        while len(left):
            multiplier = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self._levels) * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
            slot = (keys[left] * multiplier) >> np.uint64(64 - bits)
            _, firsts = np.unique(slot, return_index=True)
            table, rank = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits, np.int64)
            table[slot[firsts]], rank[slot[firsts]] = keys[left[firsts]], ranks[left[firsts]]
            self._levels.append((multiplier, np.uint64(64 - bits), table, rank))
            left = np.delete(left, firsts)
            bits = 16
        every = np.repeat(byte_ids, 256), np.tile(byte_ids, 256)
        self._byte_ranks = self.ranks(*every)

    @classmethod
    def from_json(cls, path: str) -> MergeTable:
        """From the vocabulary and merges of a tokenizers file of kind BPE."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        return cls(pairs, np.arange(len(pairs)), merged, np.array([vocab[c] for c in byte_alphabet()], np.int64))

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> MergeTable:
        """From ranks of pieces: two tokens merge with the rank of the piece they spell."""
        pairs = [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        return cls(table[:, :2], table[:, 2], np.arange(max(ranks.values()) + 1), np.array([ranks[bytes([b])] for b in range(256)], np.int64))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a huge value."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), _NONE)
        for multiplier, shift, table, rank in self._levels:
            slot = (keys * multiplier) >> shift
            out = np.where(table[slot] == keys, rank[slot], out)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.byte_ids[raw]
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        place = np.arange(len(ids), dtype=np.int64)
        # rank of the pair that starts at each token; pairs of bytes come from a small table
        rank = np.full(len(ids), _NONE)
        if len(ids) > 1:
            rank[:-1] = np.where(owner[:-1] == owner[1:], self._byte_ranks[raw[:-1].astype(np.intp) * 256 + raw[1:]], _NONE)
        kept_ids, kept_owner, kept_place = [], [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            # rank and place in one number: the minimum is the leftmost pair of the best rank
            best = np.minimum.reduceat((rank << np.int64(32)) | np.arange(len(ids)), first)
            merging = best < (_NONE << np.int64(32))
            live = np.repeat(merging, np.diff(np.append(first, len(ids))))
            kept_ids.append(ids[~live])
            kept_owner.append(owner[~live])
            kept_place.append(place[~live])
            at = best[merging] & np.int64((1 << 32) - 1)
            ids[at] = self._merged[rank[at]]
            live[at + 1] = False
            new = np.cumsum(live) - 1
            ids, owner, place, rank = ids[live], owner[live], place[live], rank[live]
            at = new[at]
            here, then = at[at + 1 < len(ids)], at[at > 0]
            rank[at] = _NONE
            here = here[owner[here] == owner[here + 1]]
            rank[here] = self.ranks(ids[here], ids[here + 1])
            then = then[owner[then - 1] == owner[then]]
            rank[then - 1] = self.ranks(ids[then - 1], ids[then])
        if not kept_ids:
            return ids, np.zeros(n, np.int64)
        flat, who = np.concatenate(kept_ids), np.concatenate(kept_owner)
        order = np.argsort(np.concatenate(kept_place), kind="stable")
        return flat[order], np.bincount(who, minlength=n)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
