"""Byte-level BPE by a rank queue on a hierarchical bitmap, and decoding."""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .pieces import Pieces, gather

RANKS = "byte_bpe_50k.tiktoken"


class RankQueue:
    """Positions by merge rank: a heap a rank, and a bitmap of ranks in levels of 64-way words.

    A set bit says that the word (or heap) below holds something, so the least rank is found
    by one find-first-set a level, whatever the number of ranks.
    """

    def __init__(self, ranks: int):
        self.heaps: dict[int, list[int]] = {}
        self.levels = []
        while True:
            ranks = ranks + 63 >> 6
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def _mark(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            was = level[word]
            level[word] = was | bit
            if was:
                break
            rank = word

    def _clear(self, rank: int) -> None:
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6

    def _least(self) -> int | None:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def push(self, rank: int, position: int) -> None:
        heap = self.heaps.get(rank)
        if heap is None:
            self.heaps[rank] = [position]
            self._mark(rank)
        else:
            heappush(heap, position)

    def pop(self) -> tuple[int, int] | None:
        """The least rank and its leftmost position."""
        if (rank := self._least()) is None:
            return None
        heap = self.heaps[rank]
        position = heappop(heap)
        if not heap:
            del self.heaps[rank]
            self._clear(rank)
        return rank, position

    def add(self, rank: int, position: int) -> None:
        """``push`` for buckets that are taken whole, so needn't be heaps."""
        bucket = self.heaps.get(rank)
        if bucket is None:
            self.fill(rank, [position])
        else:
            bucket.append(position)

    def fill(self, rank: int, positions: list[int]) -> None:
        if rank in self.heaps:
            self.heaps[rank] += positions
        else:
            self.heaps[rank] = positions
            self._mark(rank)

    def pop_bucket(self) -> tuple[int, list[int]] | None:
        """The least rank and all its positions."""
        if (rank := self._least()) is None:
            return None
        self._clear(rank)
        return rank, self.heaps.pop(rank)


#: Bytes of texts encoded together, and pieces kept for later ones: few, as a worker may sit
#: idle beside a full heap while later stages run.
TOGETHER, KEPT = 1 << 20, 300_000
#: Ids that are decoded at once; it bounds the index arrays.
DECODED = 1 << 17
#: Pre-tokens up to so many bytes share one queue; a longer one has its own.
SHORT = 256


class Bpe:
    """Encoder and decoder of one rank table. Every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.n_ranks = max(ranks.values()) + 1
        tokens: list[bytes] = [b""] * self.n_ranks
        for b, r in ranks.items():
            tokens[r] = b
        self.octets = np.frombuffer(b"".join(tokens), np.uint8)
        self.octet_count = np.fromiter(map(len, tokens), np.int64, self.n_ranks)
        self.octet_start = np.cumsum(self.octet_count) - self.octet_count
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.pieces = Pieces(self.encode, pattern, most=KEPT, size=TOGETHER)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 without one."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def encode(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, each match of the pattern in it by itself."""
        matches = [self.pattern.findall(p) for p in parts]
        tokens = list({m for found in matches for m in found})
        ids: dict[str, bytes] = {}
        short, names = [], []
        for t in tokens:
            raw = t.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                ids[t] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                ids[t] = np.array(self.long_piece(raw), "<u4").tobytes()
            else:
                short.append(raw)
                names.append(t)
        ids.update(zip(names, self.short_pieces(short), strict=True))
        return [b"".join(map(ids.__getitem__, found)) for found in matches]

    def short_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens by one queue.

        Symbols of all pieces lie in one array as linked lists. A bucket of the queue holds
        the places of its rank's pairs in all pieces; of each piece the leftmost is merged,
        its others wait in the bucket, so each piece meets its merges in its own order even
        if a merge makes a pair of lower rank. Stale places are skipped.
        """
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        sym, n = self.single[raw], len(raw)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        pair = np.full(n, -1, np.int32)
        has = np.flatnonzero(after >= 0)
        pair[has] = self.pair_rank(sym[has], sym[has + 1])
        queue = RankQueue(self.n_ranks)
        place = np.flatnonzero(pair >= 0)
        place = place[np.argsort(pair[place], kind="stable")]
        found, first = np.unique(pair[place], return_index=True)
        for r, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(place)], strict=False):
            queue.fill(r, place[i:j].tolist())
        while (got := queue.pop_bucket()) is not None:
            rank, waiting = got
            at = np.array(waiting)
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                own = owner[at]
                leftmost = np.ones(len(at), bool)
                leftmost[1:] = own[1:] != own[:-1]
                if not leftmost.all():
                    queue.fill(rank, at[~leftmost].tolist())
                    at = at[leftmost]
            gone = after[at]
            far = after[gone]
            sym[at], pair[gone], sym[gone] = rank, -1, -1
            after[at] = far
            pair[at] = -1
            more = far >= 0
            left, right = at[more], far[more]
            before[right] = left
            head = before[at]
            more = head >= 0
            heads, tails = head[more], at[more]
            places = np.concatenate([left, heads])
            ranks = self.pair_rank(np.concatenate([sym[left], sym[heads]]), np.concatenate([sym[right], sym[tails]]))
            pair[places] = ranks
            for r, p in zip(ranks.tolist(), places.tolist(), strict=True):
                if r >= 0:
                    queue.add(r, p)
        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner[alive], minlength=len(pieces)))).tolist()
        return [ids[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def long_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, in time about proportional to its length.

        Symbols are a linked list over byte offsets. The queue holds (rank of the pair,
        offset of its left symbol); an entry whose pair has changed since is skipped.
        """
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, queue = len(piece), RankQueue(self.n_ranks)
        end = list(range(1, n + 1))  # of the symbol that begins here
        before = list(range(-1, n - 1))
        pair: list[int | None] = [None] * n  # the rank that the queue holds for this offset
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                pair[i] = r
                queue.push(r, i)
        while (found := queue.pop()) is not None:
            rank, i = found
            if pair[i] != rank:
                continue
            j = end[i]
            end[i] = k = end[j]
            pair[j] = None
            if k < n:
                before[k] = i
                pair[i] = r = ranks.get(piece[i : end[k]])
                if r is not None:
                    queue.push(r, i)
            else:
                pair[i] = None
            if (h := before[i]) >= 0:
                pair[h] = r = ranks.get(piece[h:k])
                if r is not None:
                    queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids(self, text: str) -> np.ndarray:
        return next(self.pieces.each(pa.array([text], pa.string())))

    def decode(self, ids: np.ndarray) -> bytes:
        blocks = (ids[i : i + DECODED] for i in range(0, len(ids), DECODED))
        return b"".join([gather(self.octets, self.octet_start[x], self.octet_count[x]).tobytes() for x in blocks])


@cache
def load(name: str = RANKS) -> Bpe:
    """The encoder of a rank file of the tokenizers' folder, read once a worker."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Bpe(ranks, public_tokenizers.PATTERN)


def encoded(text: Column, name: str = RANKS, with_ids: bool = False) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256[, ids]> of binary UTF-8 texts.

    decoded_sha256 is taken from decoding the ids again. Invalid UTF-8 is read with
    replacement characters.
    """

    def each(texts: pa.Array) -> pa.Array:
        bpe, ids, sha, back = load(name), [], [], []
        for part, ends in bpe.pieces.batches(texts):
            raw = part.astype("<u4").tobytes()
            decoded = bpe.decode(part)
            octets = np.concatenate([[0], np.cumsum(bpe.octet_count[part])])[ends].tolist()
            stops = ends.tolist()
            sha += [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip([0, *stops[:-1]], stops, strict=True)]
            back += [hashlib.sha256(decoded[i:j]).hexdigest() for i, j in zip([0, *octets[:-1]], octets, strict=True)]
            ids.append((part.astype(np.int32) if with_ids else None, np.diff(ends, prepend=0)))
        n = np.concatenate([np.empty(0, np.int64), *[x for _, x in ids]])
        columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        if with_ids:
            values = np.concatenate([np.empty(0, np.int32), *[x for x, _ in ids]])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))
        return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>" if with_ids else "") + ">"
    return F.arrow_udf(each, kind).asNondeterministic()(text)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = RANKS, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids].

    Null counts as empty, which has no ids. Texts of any length are encoded whole.
    """
    return docs.select(F.col(id_col).alias("doc_id"), encoded(utf8(text_col), name, with_ids).alias("e")).select("doc_id", "e.*")
