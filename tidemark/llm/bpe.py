"""Byte-level BPE with the ranks of a public vocabulary file; encoding and decoding.

Two tiers: a minimal perfect hash finds a pre-token that is itself in the vocabulary;
others are merged with a heap over a linked list of their bytes.  Before both, the
pre-tokens of a chunk of texts are cut and told apart in numpy, so that each distinct
one is looked up once a chunk, and a worker remembers those it met last: two
generations of a bounded memo, of which the older is given up when the younger is full.

A caller that only needs the ids (operator 4) may have short pre-tokens merged in numpy,
many at a time, without a memo; the ids are the same.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, types as T

from .batches import chunks, map_arrow, narrow, ragged, texts, word_hashes

#: Pre-tokens of a generation of a worker's memo.
MEMO = 500_000
#: Bytes of pre-tokens whose merges are made ready at a time (one at least).
GROUP = 1 << 17
PRIME = (1 << 61) - 1

# Fixed value: the pattern of pre-tokens that is cut in numpy (any other is left to ``regex``).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """The class of each code point."""
    if not _kinds:
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _kinds.append(table)
    return _kinds[0]


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of PATTERN start in the UTF-8 bytes of texts (each at ``offsets``), and the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each character starts
    n = len(points)
    kind = _kind()[points]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[np.searchsorted(heads, offsets[:-1])] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # The last of some white space goes its own way if more of the text follows; a blank joins what follows.
    last = np.flatnonzero(space & np.append(start[1:], True) & ~edge[1:])
    start[last] = True
    blank = last[points[last] == 32]
    start[blank + 1] = False
    # 's, 't, ...: an apostrophe alone that starts a pre-token, with the first letters after it.
    for i in np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~edge[1:n]).tolist():
        two = points[i + 1 : i + 3].tolist()
        k = 1 if chr(two[0]) in "stmd" else 2 if not edge[i + 2] and len(two) == 2 and chr(two[0]) + chr(two[1]) in ("re", "ve", "ll") else 0
        if k:
            start[i + 1] = False
            if i + 1 + k < n and kind[i + 1 + k] == _LETTER and not edge[i + 1 + k]:
                start[i + 1 + k] = True
    return np.append(heads[start], len(data))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


class PerfectHash:
    """A minimal perfect hash of distinct byte strings (hash and displace): n slots for n keys."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        groups: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            bucket, first, step = self._parts(key)
            groups[bucket].append((i, first, step))
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = n - 1
        for b in order:
            group = groups[b]
            if len(group) == 1:  # any slot that is left
                while self.slots[free] >= 0:
                    free -= 1
                self.slots[free] = group[0][0]
                self.shift[b] = -free - 1
            elif group:
                d = 0
                while True:
                    spots = {(first + d * step) % PRIME % n for _, first, step in group}
                    if len(spots) == len(group) and all(self.slots[s] < 0 for s in spots):
                        break
                    d += 1
                for i, first, step in group:
                    self.slots[(first + d * step) % PRIME % n] = i
                self.shift[b] = d
        self.keys = [keys[i] for i in self.slots]

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h % self.buckets, (h >> 20) % PRIME, (h >> 64) % PRIME

    def get(self, key: bytes) -> int | None:
        bucket, first, step = self._parts(key)
        d = self.shift[bucket]
        slot = (first + d * step) % PRIME % self.n if d >= 0 else -d - 1
        return self.slots[slot] if self.keys[slot] == key else None


def pair_table(tokens: list[bytes]) -> dict[int, int]:
    """{left id << 32 | right id: id of the token that both make}, for each way to halve a token into two."""
    ranks = {token: i for i, token in enumerate(tokens)}
    get, pairs = ranks.get, {}
    for i, token in enumerate(tokens):
        for k in range(1, len(token)):
            left, right = get(token[:k]), get(token[k:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = i
    return pairs


def merge(ids: list[int], pair: list[int], heap: list[int], shift: int, pairs: dict[int, int]) -> list[int]:
    """The ids of one pre-token: again and again the adjacent pair of least rank, the leftmost first, is joined.

    ``ids``: of the part that starts at each byte; ``pair``: the rank of the pair whose left part starts there,
    -1 if it has none; ``heap``: rank << shift | place of each pair, ascending.  All three are used up.
    """
    n, get, place = len(ids), pairs.get, (1 << shift) - 1
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))
    while heap:
        top = heappop(heap)
        i = top & place
        new = top >> shift
        if pair[i] != new:
            continue  # one of its parts has gone into another
        j = after[i]
        k = after[i] = after[j]
        ids[i] = new
        ids[j] = pair[j] = -1
        if k < n:
            before[k] = i
            r = pair[i] = get(new << 32 | ids[k], -1)
            if r >= 0:
                heappush(heap, r << shift | i)
        else:
            pair[i] = -1
        p = before[i]
        if p >= 0:
            r = pair[p] = get(ids[p] << 32 | new, -1)
            if r >= 0:
                heappush(heap, r << shift | p)
    return [x for x in ids if x >= 0]


class Codec:
    """Encodes and decodes chunks of texts.

    ``short``: pre-tokens of up to so many bytes are merged in rounds (``_rounds``) without a memo, the others by heaps; ``memo``:
    pre-tokens of a generation, if not ``MEMO``.
    """

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str, short: int = 0, memo: int | None = None):
        self.table, self.short, self.memo = table, short, memo
        self.pairs = pair_table(tokens)
        ranks = {token: i for i, token in enumerate(tokens) if len(token) == 1}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        own = self.byte_ids.tolist()
        self.twos = np.array([self.pairs.get(a << 32 | b, -1) for a in own for b in own], np.int64)
        self.rank_bits = len(tokens).bit_length()
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}
        self.split = None if pattern == PATTERN else regex.compile(pattern).findall
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        if short:
            order = np.argsort(keys := np.fromiter(self.pairs, np.int64, len(self.pairs)))
            self.pair_keys, self.pair_ids = keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]
            # Whole tokens that merging doesn't lead to are looked up; commonly there are none.
            few = np.flatnonzero(self.sizes <= short)
            few = few[self._rounds(self.bytes, self.starts[few], self.sizes[few])[1] != 1]
            self.odd = word_hashes(self.bytes, self.starts[few], (self.starts + self.sizes)[few])
        names = [b"%d," % i for i in range(len(tokens))]
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.name_sizes = np.array([len(t) for t in names], np.int64)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes

    def _remember(self, raw: bytes, ids: tuple[int, ...]) -> None:
        if len(self.young) >= (self.memo or MEMO):
            self.old, self.young = self.young, {}
        self.young[raw] = ids

    def pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        buffer = data.tobytes()
        raws = [buffer[a:z] for a, z in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
        out, missed = list(map(self.young.get, raws)), []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            raw = raws[k]
            ids = self.old.get(raw)
            if ids is None:
                whole = self.table.get(raw)
                if whole is None:
                    missed.append(k)
                    continue
                ids = (whole,)
            out[k] = ids
            self._remember(raw, ids)
        at = np.array(missed, np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes[at])))
        for i, j in chunks(edges, GROUP):
            part = at[i:j]
            for k, ids in zip(part.tolist(), self._merged(data, starts[part], sizes[part]), strict=True):
                out[k] = tuple(ids)
                self._remember(raws[k], out[k])
        return out

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[list[int]]:
        """The merged ids of pre-tokens that aren't whole tokens; what their heaps start from is made for all at once."""
        x = data[ragged(starts, sizes)].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        pair = np.full(len(x), -1, np.int64)
        pair[:-1] = self.twos[x[:-1] << 8 | x[1:]]
        pair[first + sizes - 1] = -1
        shift = int(sizes.max()).bit_length()
        row = np.repeat(np.arange(len(sizes)), sizes)
        good = np.flatnonzero(pair >= 0)
        low = self.rank_bits + shift
        # By pre-token, rank and place; an ascending list is a heap.
        heap = np.sort(row[good] << low | pair[good] << shift | good - first[row[good]])
        ends = np.cumsum(np.bincount(row[good], minlength=len(sizes))).tolist()
        ids, pairs, heap = self.byte_ids[x].tolist(), pair.tolist(), (heap & ((1 << low) - 1)).tolist()
        h = 0
        for a, n, e in zip(first.tolist(), sizes.tolist(), ends, strict=True):
            yield merge(ids[a : a + n], pairs[a : a + n], heap[h:e], shift, self.pairs)
            h = e

    def _table(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each pre-token's start, how many it has)."""
        few = (sizes <= self.short) & ~np.isin(hashes, self.odd) if self.short else np.zeros(len(sizes), bool)
        short, rest = np.flatnonzero(few), np.flatnonzero(~few)
        many = np.zeros(len(sizes), np.int64)
        parts = []
        edges = np.concatenate(([0], np.cumsum(sizes[short])))
        for i, j in chunks(edges, GROUP):
            ids, many[short[i:j]] = self._rounds(data, starts[short[i:j]], sizes[short[i:j]])
            parts.append(ids)
        found = self.pieces(data, starts[rest], sizes[rest])
        many[rest] = np.fromiter(map(len, found), np.int64, len(found))
        parts.append(np.fromiter(chain.from_iterable(found), np.int32, int(many[rest].sum())))
        begin = np.zeros(len(sizes), np.int64)
        order = np.concatenate((short, rest))
        begin[order] = np.cumsum(many[order]) - many[order]
        return np.concatenate(parts), begin, many

    def _rounds(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each) as by ``_merged``: in each round each pre-token that has a pair of known rank joins that of least rank, the leftmost first.

        There are fewer rounds than bytes in the longest pre-token.
        """
        x = data[ragged(starts, sizes)]
        ids, row = self.byte_ids[x], np.repeat(np.arange(len(sizes)), sizes)
        none = 1 << self.rank_bits
        pair = np.full(len(ids), none)
        pair[:-1] = self.twos[x[:-1].astype(np.int64) << 8 | x[1:]]
        pair[pair < 0] = none
        pair[np.cumsum(sizes) - 1] = none
        done_ids, done_rows = [], []
        while len(ids):
            new = np.flatnonzero(np.diff(row, prepend=-1))
            best = np.minimum.reduceat(pair << 32 | np.arange(len(pair)), new)
            live = best >> 32 < none
            if not live.all():  # pre-tokens without such a pair are done
                kept = np.repeat(live, np.diff(new, append=len(ids)))
                done_ids.append(ids[~kept])
                done_rows.append(row[~kept])
                shift = np.cumsum(~kept)
                ids, row, pair, best = ids[kept], row[kept], pair[kept], best[live]
                at = best & 0xFFFFFFFF
                at = at - shift[at]
            else:
                at = best & 0xFFFFFFFF
            if not len(at):
                break
            ids[at] = best >> 32
            pair[at] = pair[at + 1]  # replaced below; none where the pre-token ends
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one part of each pre-token before goes
            ids, row, pair = ids[stay], row[stay], pair[stay]
            near = np.concatenate((at, at[at > 0] - 1))
            near = near[near + 1 < len(ids)]
            near = near[row[near] == row[near + 1]]
            key = ids[near] << 32 | ids[near + 1]
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            pair[near] = np.where(self.pair_keys[spot] == key, self.pair_ids[spot], none)
        rows = np.concatenate([*done_rows, np.zeros(0, np.int64)])
        flat = np.concatenate([*done_ids, np.zeros(0, np.int64)])[np.argsort(rows, kind="stable")]
        return flat.astype(np.int32), np.bincount(rows, minlength=len(sizes))

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.split is None:
            return cut(data, offsets)
        sizes = []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = [len(p.encode()) for p in self.split(data[a:z].tobytes().decode())]
            if sum(own) != z - a:
                raise ValueError("the pattern leaves out parts of a text")
            sizes += own
        return np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's start and the end)."""
        at = self._cut(data, offsets)
        starts, sizes = at[:-1], np.diff(at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes = word_hashes(data, starts, at[1:])
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        twin = first[kind]  # the first pre-token of the same hash: its bytes must be the same
        if (sizes[twin] != sizes).any() or (data[ragged(starts[twin], sizes)] != data).any():
            first = kind = np.arange(len(starts))
        table, begin, many = self._table(data, starts[first], sizes[first], hashes[first])
        ids = table[ragged(begin[kind], many[kind])]
        before = np.concatenate(([0], np.cumsum(many[kind])))
        return ids, before[np.searchsorted(at, offsets)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts, where each starts and the end) of ids laid end to end; an unknown id is an error."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.sizes):
            raise ValueError(f"ids are from 0 to {len(self.sizes) - 1}")
        sizes = self.sizes[ids]
        return self.bytes[ragged(self.starts[ids], sizes)].tobytes(), np.concatenate(([0], np.cumsum(sizes)))[ends]

    def decimals(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(decimal ids, a comma after each; where each text's start and the end)."""
        sizes = self.name_sizes[ids]
        return self.names[ragged(self.name_starts[ids], sizes)].tobytes(), np.concatenate(([0], np.cumsum(sizes)))[ends]


_codecs: dict[tuple, Codec] = {}


def _shared(spark: SparkSession, path: str, pattern: str, short: int = 0, memo: int | None = None):  # noqa: ANN202
    """A function that gives the worker's codec; the vocabulary (a file of fixed size) is broadcast."""
    tokens = read_ranks(path)
    sent = spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    key = (hashlib.sha256(b"\n".join(tokens)).hexdigest(), pattern, short, memo)

    def codec() -> Codec:
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(*sent.value, pattern, short, memo)
        return _codecs[key]

    return codec


def encode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), short: int = 0, memo: int | None = None) -> DataFrame:
    """(doc_id, columns of ``keep``, ids): the token ids of each text, as a list of ints.  Null and empty texts: an empty list.

    ``short``, ``memo``: see ``Codec``.
    """
    codec = _shared(df.sparkSession, path, pattern, short, memo)
    rows = narrow(df, doc_id=doc_id, **{c: c for c in keep}, text=text)
    fields = T.StructType([rows.schema[c] for c in rows.columns[:-1]] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def batch(b: pa.RecordBatch):  # noqa: ANN202
        data, offsets = texts(b.column(b.num_columns - 1))
        for i, j in chunks(offsets):
            ids, ends = codec().encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(b.num_columns - 1)] + [pa.ListArray.from_arrays(ends.astype(np.int32), ids)], names=fields.names)

    return map_arrow(rows, fields, batch)


def decode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of each list of ids.  A null list gives no bytes; an unknown id is an error."""
    codec = _shared(df.sparkSession, path, pattern)
    rows = narrow(df, doc_id=doc_id, ids=ids)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
        raw, at = codec().decode(np.concatenate([*lists, np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[a:z] for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "decoded"])

    return map_arrow(rows, T.StructType([rows.schema["doc_id"], T.StructField("decoded", T.BinaryType())]), batch)


def round_trip(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded.

    The digests are of the decimal ids joined by commas and of the decoded bytes.  A null text
    counts as empty (no ids); a text of any length is one row; repeated rows stay repeated.
    """
    codec = _shared(df.sparkSession, path, pattern)
    rows = narrow(df, doc_id=doc_id, text=text)
    fields = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def batch(b: pa.RecordBatch):  # noqa: ANN202
        c = codec()
        data, offsets = texts(b.column(1))
        for i, j in chunks(offsets):
            ids, ends = c.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            (names, a), (raw, d) = c.decimals(ids, ends), c.decode(ids, ends)
            a, d = a.tolist(), d.tolist()
            of_ids = [hashlib.sha256(names[x : max(x, y - 1)]).hexdigest() for x, y in zip(a[:-1], a[1:], strict=True)]
            of_bytes = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(d[:-1], d[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=fields.names)

    return map_arrow(rows, fields, batch)
