"""Byte-level BPE by merge replay: an inverted index from token pair to positions applies every merge in rank order.

The distinct pieces of a block of texts form one array of tokens with links to both neighbours. For each rank that
occurs the index holds the positions of its pair. Ranks come off a heap; all positions of a rank merge at once and
only the pairs that touch a merged token are looked up again. A rank that turns up below the current one is simply
the next to come off the heap, so every piece sees its merges in the order a greedy encoder would choose.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, tidy
from .pretokens import Dictionary, take

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of distinct pieces that are replayed at once.
REPLAY_BYTES = 1 << 20


class Merges:
    """Ranks of a vocabulary: token bytes, and for each pair of tokens the rank of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.rank = np.array([r for _, r in pairs] or [-1], np.int64)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        sizes = [len(t) for t in self.bytes]
        self.flat, self.at = np.frombuffer(b"".join(self.bytes), np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or -1."""
        key = left * self.size + right
        where = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[where] == key, self.rank[where], -1)

    def replay(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, which is a piece of its own: all joined, and how many each has. Many texts go by parts of about REPLAY_BYTES."""
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.unique(np.searchsorted(ends, np.arange(REPLAY_BYTES, int(ends[-1]), REPLAY_BYTES))).tolist() if len(texts) else []
        done = [self._replay(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True) if a < b]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _replay(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), sizes
        token = self.single[data]
        if token.min() < 0:
            raise ValueError("a byte has no rank")
        word = np.repeat(np.arange(len(texts)), sizes)
        # Links to the next and last token; n stands for none, and holds a token that pairs with nothing.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.cumsum(sizes)[sizes > 0] - 1] = n
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = n
        after, before = np.append(after, n), np.append(before, n)
        token = np.append(token, -1)
        rank = np.full(n + 1, -1, np.int64)  # of the pair that begins at a position
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.of(token[inner], token[inner + 1])
        first = inner[rank[inner] >= 0]
        first = first[np.argsort(rank[first], kind="stable")]
        values, cut = np.unique(rank[first], return_index=True)
        cut = np.append(cut, len(first)).tolist()
        index: dict[int, list[np.ndarray]] = {v: [first[cut[k] : cut[k + 1]]] for k, v in enumerate(values.tolist())}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                # Overlapping pairs: of a chain each of whose pairs begins where the last one ends, every other merges.
                chained = after[at[:-1]] == at[1:]
                if chained.any():
                    where = np.arange(len(at))
                    head = np.ones(len(at), bool)
                    head[1:] = ~chained
                    at = at[(where - np.maximum.accumulate(np.where(head, where, 0))) % 2 == 0]
            gone = after[at]
            token[at] = r
            rank[gone] = -1
            after[at] = after[gone]
            before[after[at]] = at
            before[n] = n
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left < n]]))
            fresh = np.where(after[touched] < n, self.of(token[touched], token[after[touched]]), -1)
            rank[touched] = fresh
            known = fresh >= 0
            if known.any():
                touched, fresh = touched[known], fresh[known]
                order = np.argsort(fresh, kind="stable")
                touched, fresh = touched[order], fresh[order]
                edges = (np.flatnonzero(fresh[1:] != fresh[:-1]) + 1).tolist()
                for lo, hi in zip([0, *edges], [*edges, len(touched)], strict=True):
                    v = int(fresh[lo])
                    if v not in index:
                        index[v] = []
                        heapq.heappush(heap, v)
                    index[v].append(touched[lo:hi])
        # A token lives if it heads its text or the token before it still leads to it.
        alive = after[before[:n]] == np.arange(n)
        alive[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return token[:n][alive], np.bincount(word[alive], minlength=len(texts))


@cache
def merges(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


@cache
def remembered(path: str) -> Dictionary:
    """The pieces that this worker process has replayed, for all its tasks; bounded."""
    return Dictionary(merges(path).replay, remembered=500_000)


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: doc_id, ids (binary of little-endian unsigned 32-bit ids), n_tokens, ids_sha256, decoded_sha256.

    The ids are those of the ranks at path, without special tokens; decoded_sha256 is of the bytes that they decode to.
    Null text counts as empty and has no ids. Bytes that are no UTF-8 count as U+FFFD. Repeated ids and rows stay
    apart; an empty table gives no rows; other columns are ignored.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        table = merges(path)
        words = remembered(path)
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for i, j, rows, first in words.blocks(data, offsets):
                used, back = np.unique(rows, return_inverse=True)
                ids, counts = take(words.ids, words.at, used)
                cut = np.concatenate([[0], np.cumsum(counts)])
                whole = ids.astype("<u4").tobytes()
                named = list(map(str, ids.tolist()))
                as_ids = [whole[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                as_text = [" ".join(named[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                plain, sizes = take(table.flat, table.at, ids.astype(np.int64))
                edge = np.concatenate([[0], np.cumsum(sizes)])[cut].tolist()
                plain = plain.tobytes()
                as_bytes = [plain[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
                n = counts[back]
                total = np.concatenate([[0], np.cumsum(n)])
                out = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    here = back[a:b].tolist()
                    out.append((
                        b"".join([as_ids[k] for k in here]),
                        int(total[b] - total[a]),
                        hashlib.sha256(" ".join([as_text[k] for k in here]).encode()).hexdigest(),
                        hashlib.sha256(b"".join([as_bytes[k] for k in here])).hexdigest(),
                    ))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(tidy(run), "doc_id bigint, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """tokens with a binary column decoded: the bytes of its ids. Null ids decode to nothing; an id outside the ranks is an error."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        table = merges(path)
        for batch in batches:
            out = []
            for x in batch.column(ids).to_pylist():
                got = np.frombuffer(x or b"", "<u4").astype(np.int64)
                if len(got) and got.max() >= table.size:
                    raise ValueError("an id has no token")
                out.append(take(table.flat, table.at, got)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields]
    return tokens.mapInArrow(tidy(run), ", ".join([*kinds, "decoded binary"]))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; see encoded()."""
    return encoded(docs, path).drop("ids")
