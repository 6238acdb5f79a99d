"""Removal of repeated byte strings across documents with suffix arrays.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also
starts in a document of smaller id. The work is dealt so that no suffix list
of the corpus is ever held or sent whole:

* Documents are dealt into shards by a hash of their id and text. A string's anchor is
  the 16-byte gram of the string with the smallest hash, so equal strings have
  equal anchors. A shard sends its sorted distinct anchors, cut at the range
  borders by binary search; a range of anchors finds those of two documents or
  more and sends them back; shards look theirs up by binary search. Strings
  with other anchors occur in one document only.
* For each anchor that is left, a shard sends the bytes of all strings that
  have it (their context), each distinct context once with its smallest
  document, so that a passage of a third of all documents is a few rows.
* A range builds a suffix array of its distinct contexts by Larsson-Sadakane
  refinement, takes common prefixes after Kasai, and finds the smallest
  document of each run of equal strings. Shards get one bit for each string.

The shuffled documents are one exchange that three steps read.

Rows: a null or empty text has no bytes, nothing is removed. Rows that repeat a
doc_id are the same document: they never remove each other's bytes (ties of
ids). A null doc_id takes no part and is not dealt: nothing is removed from it
or for it. A very long text is in one shard. Empty table: empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
#: Bytes of a gram that can be an anchor, and grams of a string.
GRAM = 16
GRAMS = LENGTH - GRAM + 1
#: Bytes of text in a shard, and of text for each range of anchors, about.
SHARD_BYTES = 4 << 20
#: Starts whose anchors are found at a time.
PIECE = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_PLACE = np.uint64((1 << 21) - 1)
_MESSAGE = "key long, src long, a binary, b binary, c binary, d binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    return x ^ (x >> np.uint64(27))


def _words(buffer: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each place of a buffer, as a view."""
    return np.ndarray(max(0, len(buffer) - 7), order, buffer=buffer, strides=(1,))


def segments(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor) of the runs of strings that
    share an anchor occurrence, over a document's bytes (uint8)."""
    firsts, counts, anchors = [], [], []
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        part = text[at : at + PIECE + LENGTH - 1]
        w = _words(part)
        low = w[: len(part) - GRAM + 1] * _A
        h = _mixed((low ^ (low >> np.uint64(32))) * _B + w[8 : 8 + len(low)])
        # smallest hash first, then the leftmost: the place is in the low bits
        best, span = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * span <= GRAMS:
            best, span = np.minimum(best[:-span], best[span:]), 2 * span
        if span < GRAMS:
            best = np.minimum(best[: span - GRAMS], best[GRAMS - span :])
        place = (best & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, len(place))))
        anchors.append(_mixed(h[place[first]] + _B))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *counts]), np.concatenate([none.astype(np.uint64), *anchors])


class Shard:
    """The documents of a shard in order of id, their bytes side by side, and
    the runs of strings of all documents (places in the joined bytes)."""

    def __init__(self, table: pa.Table, bits: int):
        table = table.select(["id", "text"]).sort_by([("id", "ascending"), ("text", "ascending")])
        self.rows = table
        texts = [t or b"" for t in table.column("text").to_pylist()]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = table.column("id").to_numpy(zero_copy_only=False)
        self.bits = bits

    def find(self) -> "Shard":
        found = [(i, segments(self.bytes[self.offsets[i] : self.offsets[i + 1]])) for i in range(len(self.sizes)) if self.rows.column("id")[i].is_valid and self.sizes[i] >= LENGTH]
        self.first = np.concatenate([np.empty(0, np.int64), *(f + self.offsets[i] for i, (f, _, _) in found)])
        self.count = np.concatenate([np.empty(0, np.int64), *(c for _, (_, c, _) in found)])
        self.doc = np.concatenate([np.empty(0, np.int64), *(np.full(len(c), self.ids[i], np.int64) for i, (_, c, _) in found)])
        hashed = np.concatenate([np.empty(0, np.uint64), *(a for _, (_, _, a) in found)])
        # the range of anchors, then up to 48 bits: anchors that share them by chance only add candidates
        low = _low_bits(self.bits)
        self.anchor = ((hashed >> np.uint64(64 - self.bits) << np.uint64(low)) if self.bits else np.uint64(0)) | (hashed & np.uint64((1 << low) - 1))
        return self


def _low_bits(bits: int) -> int:
    """Bits of an anchor below the number of its range."""
    return min(48, 64 - bits)


def _pack(keys: np.ndarray) -> bytes:
    """The low six bytes of each key, which hold all below its range."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _low_part(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys & np.uint64((1 << _low_bits(bits)) - 1)


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "src", "a", "b", "c", "d"])


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The non-empty ranges of sorted keys, cut by binary search."""
    of = keys >> np.uint64(_low_bits(bits)) if bits else np.zeros(len(keys), np.uint64)
    every = np.unique(of)
    edges = np.append(np.searchsorted(of, every), len(keys))
    for r, a, b in zip(every.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
        yield r, slice(a, b)


def send_anchors(shard_id: int, shard: Shard) -> list[tuple]:
    """To each range: the shard's distinct anchors of one document, and those of more."""
    order = np.lexsort((shard.doc, shard.anchor))
    keys, first = np.unique(shard.anchor[order], return_index=True)
    docs = shard.doc[order]
    many = docs[first] != docs[np.append(first[1:], len(docs)) - 1] if len(first) else np.empty(0, bool)
    return [(r, shard_id, _pack(keys[s][~many[s]]), _pack(keys[s][many[s]]), None, None) for r, s in _ranges(keys, shard.bits)]


def shared_anchors(table: pa.Table) -> list[tuple]:
    """In a range: to each shard those of its anchors that two documents have."""
    src, r = table.column("src").to_pylist(), table.column("key")[0].as_py()
    single = [_unpack(x) for x in table.column("a").to_pylist()]
    many = [_unpack(x) for x in table.column("b").to_pylist()]
    every = np.sort(np.concatenate([*single, *many]))
    again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *many]))
    out = []
    for s, one, more in zip(src, single, many):
        at = np.searchsorted(again, one)
        hit = one[again[np.minimum(at, len(again) - 1)] == one] if len(again) else one[:0]
        if len(hit) + len(more):
            out.append((s, r, _pack(np.sort(np.concatenate([hit, more]))), None, None, None))
    return out


def send_contexts(shard_id: int, shard: Shard, shared: pa.Table) -> list[tuple]:
    """To each range: distinct contexts (bytes, lengths, smallest documents).
    To itself, by a key behind the ranges: its runs and where their contexts went."""
    found = [np.empty(0, np.uint64)]
    for r, a in sorted(zip(shared.column("src").to_pylist(), shared.column("a").to_pylist())):
        found.append(_low_part(_unpack(a), shard.bits) | (np.uint64(r << _low_bits(shard.bits)) if shard.bits else np.uint64(0)))
    known = np.concatenate(found)
    if not len(known):
        return []
    at = np.searchsorted(known, shard.anchor)
    use = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == shard.anchor)
    use = use[np.argsort(shard.anchor[use], kind="stable")]
    out, home = [], []
    for r, s in _ranges(shard.anchor[use], shard.bits):
        runs = use[s]
        first, size = shard.first[runs], shard.count[runs] + LENGTH - 1
        padded = np.zeros((len(runs), GRAMS + LENGTH), np.uint8)
        inside = np.arange(padded.shape[1]) < size[:, None]
        padded[inside] = shard.bytes[np.repeat(first, size) + _steps(size)]
        padded[:, -1] = size  # tells a context from one that ends in zero bytes
        _, one, which = np.unique(np.ascontiguousarray(padded).view(f"V{padded.shape[1]}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, which, shard.doc[runs])
        later = shard.doc[runs] > least[which]
        out.append((r, shard_id, pa.compress(padded[one][inside[one]].tobytes(), "zstd", asbytes=True), size[one].astype(np.uint8).tobytes(), least.tobytes(), None))
        home.append((r, np.stack([first, size, which, later]).astype(np.int32 if len(shard.bytes) < 1 << 31 else np.int64)))
    return [*out, *(((1 << shard.bits) + shard_id, r, x.tobytes(), str(x.dtype).encode(), None, None) for r, x in home)]


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each). Larsson and Sadakane: sort by eight
    bytes, then refine groups of equal suffixes by the ranks of what follows,
    twice as far each time, until every group is one suffix."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    head = _words(padded, ">u8")[:n].astype(np.uint64)
    # suffixes of less than eight bytes come before those that only their padding
    # equals, the shortest first, and are groups of their own
    whole = max(0, n - 7)
    order, short = np.argsort(head[:whole]), np.arange(n - 1, whole - 1, -1)
    short = short[np.argsort(head[short], kind="stable")]
    at = np.searchsorted(head[order], head[short])
    order = np.insert(order, at, short)
    sorted_head = head[order]
    new = np.concatenate([[True], sorted_head[1:] != sorted_head[:-1], [True]])
    at += np.arange(len(short))
    new[at] = new[at + 1] = True
    new = new[:n]
    del padded, head, sorted_head
    small = np.int32 if n < 1 << 31 else np.int64
    order, rank = order.astype(small), np.empty(n, small)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    reach = 8
    while True:
        # the groups of two and more; a group's rank is its first place in the order
        single = new & np.append(new[1:], True)
        places = np.flatnonzero(~single)
        if not len(places):
            break
        group = order[places]
        ahead = np.where(group < n - reach, rank[np.minimum(group, n - 1 - reach) + reach] + 1, 0) if reach < n else np.zeros(len(group), small)
        key = (rank[group].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        by = np.argsort(key)
        group, key = group[by], key[by]
        order[places] = group
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        new = single
        new[places] = differs
        start = places[differs][np.cumsum(differs) - 1]
        rank[group] = start
        reach *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 64) -> np.ndarray:
    """Kasai: the common prefix of each suffix with the one before it in the
    order, up to ``most``. It shrinks by one at most from a place to the next,
    so each lane of places goes on from what its last place had; the lanes
    run side by side."""
    n = len(text)
    out = np.zeros(n, np.int64)
    words = _words(np.concatenate([text, np.zeros(most + 8, np.uint8)])).astype(np.uint64)
    starts = np.arange(0, n, lanes)
    have = np.zeros(len(starts), np.int64)
    for step in range(lanes):
        i = starts + step
        i = i[i < n]
        h = np.maximum(have[: len(i)] - 1, 0)
        ahead = rank[i]
        go = np.flatnonzero(ahead > 0)
        h[ahead == 0] = 0
        before = order[ahead - 1]
        while len(go):
            a, b = i[go] + h[go], before[go] + h[go]
            differ = words[a] ^ words[b]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(lowest.astype(np.float64) + (differ == 0)).astype(np.int64)) >> 3)
            same = np.minimum(same, np.minimum(n - np.maximum(a, b), most - h[go]))
            h[go] += same
            go = go[(differ == 0) & (h[go] < most) & (np.maximum(a, b) + same < n)]
        out[ahead] = h
        have = h
    return out


def repeated(texts: list[bytes], sizes: list[np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """For each source: for each of its contexts a bit mask of the strings
    that a smaller document than the context's own has too."""
    size = np.concatenate(sizes).astype(np.int64)
    doc = np.concatenate(docs)
    text = np.frombuffer(b"".join(texts), np.uint8)
    place = np.concatenate([[0], np.cumsum(size)[:-1]])
    # equal contexts of several shards are sorted once, with their smallest document
    padded = np.zeros((len(size), GRAMS + LENGTH), np.uint8)
    inside = np.arange(padded.shape[1]) < size[:, None]
    padded[inside] = text
    padded[:, -1] = size
    _, one, which = np.unique(np.ascontiguousarray(padded).view(f"V{padded.shape[1]}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    once = text[np.repeat(place[one], size[one]) + _steps(size[one])]
    order, rank = suffix_array(once)
    prefix = common_prefixes(once, order, rank, LENGTH)
    # starts of whole strings, in the order of the suffixes
    strings = size[one] - LENGTH + 1
    owner = np.repeat(np.arange(len(one)), strings)
    begin = np.repeat(np.concatenate([[0], np.cumsum(size[one])[:-1]]), strings) + _steps(strings)
    run_of = np.cumsum(prefix < LENGTH)
    run = run_of[rank[begin]]
    smallest = np.full(run_of[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, run, least[owner])
    first = smallest[run]  # the first document that has each string
    ends = np.cumsum(strings)
    # each source context against the strings of its distinct context
    per = strings[which]
    bit = _steps(per)
    string = np.repeat(ends[which] - strings[which], per) + bit
    removed = (first[string] < np.repeat(doc, per)).astype(np.uint64) << bit.astype(np.uint64)
    masks = np.bitwise_or.reduceat(removed, np.concatenate([[0], np.cumsum(per)[:-1]]))
    return np.split(masks, np.cumsum([len(s) for s in sizes])[:-1])


def answer(table: pa.Table, ranges: int) -> list[tuple]:
    """In a range: masks for each shard. A shard's own runs are handed back."""
    key, src = table.column("key")[0].as_py(), table.column("src").to_pylist()
    if key >= ranges:
        return [(key - ranges, r, None, None, a, b) for r, a, b in zip(src, table.column("a").to_pylist(), table.column("b").to_pylist())]
    sizes = [np.frombuffer(x, np.uint8) for x in table.column("b").to_pylist()]
    texts = [pa.decompress(x, int(n.sum()), "zstd", asbytes=True) for x, n in zip(table.column("a").to_pylist(), sizes)]
    masks = repeated(texts, sizes, [np.frombuffer(x, np.int64) for x in table.column("c").to_pylist()])
    return [(s, key, m.tobytes(), None, None, None) for s, m in zip(src, masks)]


def cut(shard: Shard, answers: pa.Table) -> pa.Table:
    """(id, n_bytes, spans, kept) of a shard's documents."""
    masks, runs = {}, {}
    for r, a, c, d in zip(*(answers.column(n).to_pylist() for n in ("src", "a", "c", "d"))):
        if a is not None:
            masks[r] = np.frombuffer(a, np.uint64)
        else:
            runs[r] = np.frombuffer(c, np.dtype(d.decode())).reshape(4, -1).astype(np.int64)
    change = np.zeros(len(shard.bytes) + 1, np.int32)
    for r, (first, size, which, later) in runs.items():
        strings = size - LENGTH + 1
        mask = np.where(later == 1, (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1), masks[r][which])
        bit = _steps(strings)
        begin = (np.repeat(first, strings) + bit)[(np.repeat(mask, strings) >> bit.astype(np.uint64) & np.uint64(1)).astype(bool)]
        change[begin] += 1  # a place starts one string
        change[begin + LENGTH] -= 1
    gone = np.cumsum(change[:-1]) > 0
    spans, kept = [], []
    for i in range(len(shard.sizes)):
        own = gone[shard.offsets[i] : shard.offsets[i + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
        kept.append(shard.bytes[shard.offsets[i] : shard.offsets[i + 1]][~own].tobytes())
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.table([shard.rows.column("id").combine_chunks().cast(pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    bits = (shards - 1).bit_length()  # as many ranges as shards, so neither grows with the text
    # rows are compared by id wherever they are, so an id of many rows is dealt by their texts too
    dealt = rows.where("id is not null").withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    by_shard = dealt.groupBy("shard")

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _messages(send_anchors(key[0].as_py(), Shard(table, bits).find()))

    def contexts(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return _messages(send_contexts(key[0].as_py(), Shard(left, bits).find(), right) if left.num_rows and right.num_rows else [])

    def cut_out(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return cut(Shard(left, bits), right)

    sent = by_shard.applyInArrow(anchors, _MESSAGE)
    shared = sent.groupBy("key").applyInArrow(lambda t: _messages(shared_anchors(t)), _MESSAGE)
    strings = by_shard.cogroup(shared.groupBy("key")).applyInArrow(contexts, _MESSAGE)
    answers = strings.groupBy("key").applyInArrow(lambda t: _messages(answer(t, 1 << bits)), _MESSAGE)
    out = by_shard.cogroup(answers.groupBy("key")).applyInArrow(cut_out, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    # rows without id take no part
    span = "array<struct<start:long,end:long>>"
    text = F.coalesce("text", F.lit(b""))
    unnamed = rows.where("id is null").select("id", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast(span).alias("spans"), text.alias("kept"))
    return out.unionByName(unnamed).withColumnRenamed("id", id_col)
