"""Removal of byte strings that also start in an earlier document, through run-length indexes.

Which documents to compare follows from anchors: places whose hash of ``GRAM`` bytes is the least
of some window, chosen so that every ``match`` bytes hold one, and equal bytes hold equal ones. Anchors that
meet no other document are done with. The others send the bytes around them to the bucket of their
group: an area of the first document with the anchor, so that copies of one document meet there. What a text
sends to a group are regions: the bytes that may match around its anchors, joined where they overlap.

A bucket of groups keeps each distinct region once, with its earliest document; later copies of it are covered as a
whole. Regions that differ are cut into the bytes around their anchors. Of these, equal ones are covered by
the earliest, and those that differ around one anchor are streamed as matching statistics against run-length
indexes of all but the latest of them. A long match removes ``match`` bytes if an earlier document holds them.

Documents lie in blocks by a hash of id and text, shuffled once; each stage reads them from there and orders them anew.
Hashes, answers, regions and spans go as one row per block and bucket, which numbers documents by their place in the
block. Blocks combine before every shuffle: an anchor hash, or a region, that a block holds in many documents is sent
once, so a passage that a third of all documents share is sent once a block. An anchor with more than ``HOT_PLACES`` places sends all strings of ``match`` bytes around it instead, each to a group of
its own hash: equal ones still meet, and no bucket gets the anchor as a whole. A group therefore has at most
``HOT_PLACES`` places of each anchor in ``AREA`` bytes.

Rows between blocks and buckets grow with the square of the table, so there are no more buckets than the shared anchors
fill, and large tables send up to ``WIDE`` buckets as one row, to one task that works on them one after the other.

Defined results: a null text has no bytes; rows with one id don't remove each other's bytes; a row
without an id has the rank of the largest id; texts shorter than ``match`` stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import text_bytes, total_bytes
from fleetgrid.llm.rindex import RunIndex

MATCH = 50
GRAM = 20
BLOCK = 16_000_000
HASH_BUCKET = 16_000_000
BUCKET_BYTES = 8_000_000
INDEX_SYMBOLS = 400_000
HOT_PLACES = 4_000
HOT_BUCKETS = 8
WIDE = 8
WIDE_GROUPS = 64
AREA = 2_048
CHUNK = 1 << 20
LAST_ID = (1 << 63) - 1
FACTOR = 0xD6E8FEB86659FD93


def gram_hashes(text: bytes, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at every place, from hashes of power-of-two lengths."""
    n = len(text) - size + 1
    level = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    level ^= level >> np.uint64(31)
    whole, at, width = np.zeros(n, np.uint64), 0, 1
    while True:
        if size & width:
            whole = whole * np.uint64(pow(FACTOR, width, 1 << 64)) + level[at : at + n]
            at += width
        if width * 2 > size:
            break
        level = level[:-width] * np.uint64(pow(FACTOR, width, 1 << 64)) + level[width:]
        width *= 2
    whole ^= whole >> np.uint64(32)
    whole *= np.uint64(FACTOR)
    return whole ^ (whole >> np.uint64(29))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(text: bytes, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a text; a long one is looked at in overlapping chunks."""
    if len(text) <= CHUNK:
        return anchors_of(text, match)
    found = []
    for start in range(0, len(text), CHUNK):
        begin = max(start - 2 * match, 0)
        places, hashes = anchors_of(text[begin : start + CHUNK + 2 * match], match)
        places = places + begin
        mine = (places >= start) & (places < start + CHUNK)
        found.append((places[mine], hashes[mine]))
    return tuple(np.concatenate(column) for column in zip(*found))


def anchors_of(text: bytes, match: int) -> tuple[np.ndarray, np.ndarray]:
    if len(text) < match:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(text, GRAM)
    width = match - GRAM + 1
    edge = np.zeros(width - 1, np.uint64)
    least = np.concatenate([edge, sliding(hashes, width, np.minimum), edge])
    places = np.flatnonzero(hashes == sliding(least, width, np.maximum))
    return places, hashes[places]


def short(hashes: np.ndarray) -> np.ndarray:
    """The half of a hash that tells anchors of one bucket apart; a rare clash only costs a comparison."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then all their next ones, so that small numbers shrink when a shuffle compresses them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def numbers(blob: bytes, kind: type) -> np.ndarray:
    """The numbers that ``planes`` wrote, as 64 bits."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel().astype(np.int64)


def steps(values: np.ndarray, kind: type) -> bytes:
    """Ascending numbers as their differences."""
    return planes(np.diff(values, prepend=0).astype(kind))


def climbed(blob: bytes, kind: type) -> np.ndarray:
    return np.cumsum(numbers(blob, kind))


def parts_of(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return list(zip(first.tolist(), [*first[1:].tolist(), len(sorted_)]))


def in_order(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """(ids, rows) of a block by id and mark; the shuffle gives the rows of a block in any order."""
    at, mark = (table.column(n).to_numpy() for n in ("at", "mark"))
    order = np.lexsort((mark, at))
    return at[order], table.take(pa.array(order))


class BlockAnchors:
    """Anchors of the texts of a block, and its distinct anchor hashes in the order in which they go to their buckets.

    A block is computed anew by each stage that needs it; equal rows give equal anchors, so answers need name no document.
    """

    def __init__(self, texts: list[bytes], buckets: int, match: int) -> None:
        each = [anchors(text, match) for text in texts]
        self.place, hashes = (np.concatenate([e[k] for e in each]) if each else np.zeros(0, np.int64) for k in (0, 1))
        self.ref = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
        order = np.argsort(hashes, kind="stable")
        fresh = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(order))[: len(first)] - 1
        keys, refs = hashes[order[first]], self.ref[order[first]]
        bucket = bucket_of(keys, buckets)
        # By first document within a bucket, where references hardly climb.
        sent = np.lexsort((refs, bucket))
        self.bucket, self.keys, self.refs = bucket[sent], short(keys[sent]), refs[sent]
        self.times = (last - first + 1)[sent]
        self.many = (self.ref[order[last]] != refs)[sent]
        self.areas = self.place[order[first]][sent] // AREA
        number = np.empty(len(sent), np.int64)
        number[sent] = np.arange(len(sent))
        self.number = np.empty(len(order), np.int64)
        self.number[order] = number[np.cumsum(fresh) - 1]


HASHES = "bucket int, block int, keys binary, refs binary, times binary, areas binary, many binary"


def send_hashes(buckets: int, match: int):
    """Group: per bucket the distinct anchor hashes of a block, with first document, its area and number of places."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, table = in_order(table)
        own = BlockAnchors(text_bytes(table.column("text")), buckets, match)
        rows = []
        for start, end in parts_of(own.bucket):
            here = slice(start, end)
            small = (planes(v[here].astype(np.uint32)) for v in (own.times, own.areas))
            many = np.packbits(own.many[here]).tobytes()
            rows.append((int(own.bucket[start]), block, own.keys[here].tobytes(), steps(own.refs[here], np.uint32), *small, many))
        return as_table(rows, HASHES)

    return run


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(part.split() for part in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def bucket_of(hashes: np.ndarray, count: int) -> np.ndarray:
    return (hashes % np.uint64(count)).astype(np.int64)


ANSWERS = "block int, bucket int, shared binary, groups binary, places int, hot int"


def answer_hashes(hot_places: int):
    """Group: per block which of its anchor hashes more than one document holds, with the group that compares each.

    A group is an area of the first document of the first block with the anchor; group 0 stands for anchors with very many
    places. Two groups with one number only meet in one bucket. ``places`` and ``hot`` count the shared places of the block.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda row: row["block"])
        keys = [np.frombuffer(row["keys"], np.uint32) for row in rows]
        sizes = [len(k) for k in keys]
        refs = np.concatenate([climbed(row["refs"], np.uint32) for row in rows])
        times, areas = (np.concatenate([numbers(row[n], np.uint32) for row in rows]) for n in ("times", "areas"))
        many = np.concatenate([np.unpackbits(np.frombuffer(row["many"], np.uint8), count=n) for row, n in zip(rows, sizes)])
        block = np.repeat([row["block"] for row in rows], sizes)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        fresh = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
        first = np.flatnonzero(fresh)
        shared = (np.diff(np.append(first, len(order))) > 1) | (np.add.reduceat(many[order].astype(np.int64), first) > 0)
        heads = order[first]
        group = (mixed(block[heads], refs[heads], areas[heads]) & 0xFFFFFFFF) | 1
        group[np.add.reduceat(times[order], first) > hot_places] = 0
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        out, end = [], 0
        for row, size in zip(rows, sizes):
            here = number[end : end + size]
            end += size
            asked = shared[here]
            if asked.any():
                groups, held = group[here[asked]], times[end - size : end][asked]
                counts = int(held[groups > 0].sum()), int(held[groups == 0].sum())
                out.append((row["block"], bucket, np.packbits(asked).tobytes(), groups.astype(np.uint32).tobytes(), *counts))
        return as_table(out, ANSWERS)

    return run


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A positive 62-bit hash of each row."""
    found = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        found = (found ^ column.astype(np.int64).view(np.uint64)) * np.uint64(FACTOR)
        found ^= found >> np.uint64(31)
    return ((found >> np.uint64(2)) | np.uint64(1)).astype(np.int64)


REGIONS = "bucket int, block int, fine binary, ats binary, refs binary, starts binary, sizes binary, around binary"


def region_buckets(places: int, hot: int, size: int, match: int, bucket_bytes: int) -> tuple[int, int, int]:
    """How many buckets the regions around so many shared places fill, how many of them are one row, and how many buckets
    the strings around hot places fill."""
    # A region has the bytes around an anchor; if all anchors were shared, one came every (match - GRAM + 2) / 2 bytes, and
    # regions overlapped their neighbours. Strings around hot anchors have buckets of their own, larger ones, which hold no
    # index: there may be one at every byte.
    bytes_ = min(places * (2 * match - GRAM), size * 2 * match // (match - GRAM + 2))
    count = max(1, -(-bytes_ // bucket_bytes))
    hot_count = max(1, -(-min(hot * (match - GRAM + 1), size) * match // (HOT_BUCKETS * bucket_bytes)))
    return count, max(1, min(WIDE, count // WIDE_GROUPS)), hot_count


def send_regions(buckets: int, size: int, match: int, bucket_bytes: int):
    """Group: the regions of a block around repeated anchors, to the bucket of their group. Strings around hot anchors have
    negative buckets.

    Of equal regions of a block the earliest document's goes; what it covers in later ones is sent as spans without bytes.
    """

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return as_table([], REGIONS)
        all_places, all_hot = (answers.column(n)[0].as_py() for n in ("all_places", "all_hot"))
        count, wide, hot_count = region_buckets(all_places, all_hot, size, match, bucket_bytes)
        block = answers.column("block")[0].as_py()
        at, table = in_order(table)
        texts, ats = text_bytes(table.column("text")), at.tolist()
        own = BlockAnchors(texts, buckets, match)
        group_of = np.full(len(own.keys), -1)
        for row in answers.select(["bucket", "shared", "groups"]).to_pylist():
            start, end = np.searchsorted(own.bucket, row["bucket"], "left"), np.searchsorted(own.bucket, row["bucket"], "right")
            asked = np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=end - start).astype(bool)
            group_of[start + np.flatnonzero(asked)] = np.frombuffer(row["groups"], np.uint32)
        group = group_of[own.number]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        earliest: dict[tuple[int, bytes], int] = {}
        sent: list[tuple[int, int, int, int, bytes]] = []
        done: list[tuple[int, int, int]] = []
        usual = group > 0
        for ref, start, end, of in regions_of(own.ref[usual], own.place[usual], group[usual], lengths, match):
            around = texts[ref][start:end]
            bucket = of % count
            # Documents come by id, so the first to hold a region is the earliest.
            if earliest.setdefault((bucket, around), ats[ref]) == ats[ref]:
                sent.append((bucket // wide, bucket % wide, ref, start, around))
            else:
                done.append((ref, start, end))
        rows = []
        sent.sort(key=lambda region: region[0])
        for first, last in parts_of(np.fromiter((region[0] for region in sent), np.int64, len(sent))):
            _, fine, refs, starts, around = zip(*sent[first:last])
            rows.append(region_row(sent[first][0], block, at, fine, refs, starts, [len(a) for a in around], b"".join(around)))
        covered = [np.array(done, np.int64).reshape(-1, 3).T]
        hot = group == 0
        if hot.any():
            strings = HotStrings(texts, at, own.ref[hot], own.place[hot], lengths, match)
            rows += strings.rows(block, hot_count)
            covered.append(strings.covered())
        refs, starts, ends = joined(*np.concatenate(covered, 1))
        if len(refs):
            rows.append(region_row(block % -(-count // wide), block, at, np.zeros(len(refs)), refs, starts, ends - starts, None))
        return as_table(rows, REGIONS)

    return run


class HotStrings:
    """All strings of ``match`` bytes around the hot anchors of a block, by document and place, and which of them an earlier
    document of the block holds."""

    def __init__(self, texts: list[bytes], at: np.ndarray, ref: np.ndarray, place: np.ndarray, lengths: np.ndarray, match: int) -> None:
        self.at, self.match, data = at, match, np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum(lengths) - lengths
        low, high = base[ref] + np.maximum(place - (match - GRAM), 0), base[ref] + np.minimum(place, lengths[ref] - match)
        place = np.flatnonzero(within(low, high + 1, len(data)))
        self.ref = np.searchsorted(base, place, "right") - 1
        self.start = place - base[self.ref]
        # Only the bytes of these strings are hashed, one stretch after the other.
        held = within(low, high + match, len(data))
        self.place, data = (np.cumsum(held) - 1)[place], data[held]
        self.windows = np.lib.stride_tricks.sliding_window_view(data, match)
        self.hashes = np.empty(len(place), np.uint64)
        for begin in range(0, len(data), CHUNK):
            a, b = np.searchsorted(self.place, (begin, begin + CHUNK))
            if a < b:
                piece = data[begin : begin + CHUNK + match - 1].tobytes()
                self.hashes[a:b] = gram_hashes(piece, match)[self.place[a:b] - begin]
        order = np.argsort(self.hashes, kind="stable")
        fresh = np.concatenate([[True], self.hashes[order[1:]] != self.hashes[order[:-1]]])
        first = np.empty(len(order), np.int64)
        first[order] = order[fresh][np.cumsum(fresh) - 1]
        # Documents come by id, so the first to hold a string is the earliest; another string with its hash is sent.
        self.done = at[self.ref] != at[self.ref[first]]
        later = np.flatnonzero(self.done)
        for begin in range(0, len(later), CHUNK):
            some = later[begin : begin + CHUNK]
            self.done[some] = (self.windows[self.place[some]] == self.windows[self.place[first[some]]]).all(1)

    def rows(self, block: int, hot_count: int) -> list[tuple]:
        """Those to be compared with other blocks, by hash, to negative buckets."""
        sent = np.flatnonzero(~self.done)
        bucket = bucket_of(self.hashes[sent], hot_count)
        order = np.argsort(bucket, kind="stable")
        sent, bucket = sent[order], bucket[order]
        out = []
        for a, b in parts_of(bucket):
            here = sent[a:b]
            none, sizes = np.zeros(b - a), np.full(b - a, self.match)
            around = self.windows[self.place[here]].tobytes()
            out.append(region_row(-1 - int(bucket[a]), block, self.at, none, self.ref[here], self.start[here], sizes, around))
        return out

    def covered(self) -> np.ndarray:
        """Documents, starts and ends of the strings that an earlier document of the block holds."""
        return np.stack([self.ref[self.done], self.start[self.done], self.start[self.done] + self.match])


def within(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1], dtype=np.int32) > 0


def region_row(bucket: int, block: int, at: np.ndarray, fine, refs, starts, sizes, around: bytes | None) -> tuple:
    refs = np.asarray(refs, np.int64)
    return (
        bucket,
        block,
        planes(np.asarray(fine, np.uint8)),
        steps(at[refs], np.int64),
        steps(refs, np.uint32),
        *(planes(np.asarray(v, np.uint32)) for v in (starts, sizes)),
        around,
    )


def regions_of(ref: np.ndarray, place: np.ndarray, group: np.ndarray, lengths: np.ndarray, match: int):
    """(document, start, end, group) of what a block sends, by document: the bytes that may match around anchors of one
    group, joined where they overlap."""
    if not len(ref):
        return
    starts, ends = np.maximum(place - (match - GRAM), 0), np.minimum(place + match, lengths[ref])
    fresh = (ref[1:] != ref[:-1]) | (group[1:] != group[:-1]) | (starts[1:] > ends[:-1])
    first = np.flatnonzero(np.concatenate([[True], fresh]))
    last = np.append(first[1:] - 1, len(ref) - 1)
    yield from zip(ref[first].tolist(), starts[first].tolist(), ends[last].tolist(), group[first].tolist())


SPANS = "block int, refs binary, starts binary, ends binary"


def answer_regions(match: int):
    """Group: per block the spans of a row of buckets that an earlier document also holds.

    Negative buckets hold strings of ``match`` bytes alone, which only match where they are equal.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out, regions = [], []
        for row in table.to_pylist():
            refs, at = climbed(row["refs"], np.uint32), climbed(row["ats"], np.int64)
            start, size = numbers(row["starts"], np.uint32), numbers(row["sizes"], np.uint32)
            block = np.full(len(refs), row["block"])
            if row["around"] is None:
                out.append((block, refs, start, start + size))
            else:
                regions.append((np.frombuffer(row["fine"], np.uint8), block, refs, at, start, size, row["around"]))
        if regions:
            *columns, data = zip(*regions)
            fine, *columns = (np.concatenate(column) for column in columns)
            offsets = np.concatenate([[0], np.cumsum(columns[-1])]).astype(np.int32)
            around = pa.Array.from_buffers(pa.binary(), len(fine), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])
            order = np.argsort(fine, kind="stable")
            for a, b in parts_of(fine[order]):
                here = order[a:b]
                out += covered_spans(*(column[here] for column in columns), around.take(pa.array(here)), bucket >= 0)
        block, ref, start, end = (np.concatenate(column) for column in zip(*out))
        order = np.lexsort((ref, block))
        block, ref, start, end = block[order], ref[order], start[order], end[order]
        rows = []
        for a, b in parts_of(block):
            columns = (planes(v[a:b].astype(np.uint32)) for v in (start, end))
            rows.append((int(block[a]), steps(ref[a:b], np.uint32), *columns))
        return as_table(rows, SPANS)

    def covered_spans(block, ref, at, start, size, around: pa.Array, indexed: bool):
        """Spans of the regions of one bucket that an earlier document also holds."""
        coded = around.dictionary_encode()
        which, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        bounds = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        owner = np.full(len(distinct), LAST_ID)
        np.minimum.at(owner, which, at)
        later = at > owner[which]
        yield block[later], ref[later], start[later], start[later] + size[later]
        if indexed:
            region, first, last = long_matches(data, bounds[:-1], np.diff(bounds), owner, match)
            rows = np.flatnonzero(~later)
            low, high = np.searchsorted(region, which[rows], "left"), np.searchsorted(region, which[rows], "right")
            times = high - low
            rows = np.repeat(rows, times)
            ends = np.cumsum(times)
            span = np.repeat(low - (ends - times), times) + np.arange(len(rows))
            yield block[rows], ref[rows], start[rows] + first[span], start[rows] + last[span]

    return run


def long_matches(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, match: int, most: int = INDEX_SYMBOLS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, start, end), by region: bytes of regions in strings of ``match`` bytes that a region with a smaller owner holds.

    Regions are cut into the bytes around their anchors. Equal ones have the owner of the earliest; of those that differ
    around one anchor, all but the last go into run-length indexes, in parts of about ``most`` symbols, and all but
    the first are streamed against them.
    """
    region, place, key = region_anchors(data, starts, lengths, match)
    reach = match - GRAM
    low = np.maximum(place - reach, 0)
    size = np.minimum(place + match, lengths[region]) - low
    content = content_hashes(data, starts[region] + low, size)
    order = np.lexsort((owner[region], size, content, key))
    fresh = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(content[order]) != 0) | (np.diff(size[order]) != 0)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    least, anchor = owner[region[first]], key[first]
    whole = least[number] < owner[region]
    found = [(region[whole], low[whole], low[whole] + size[whole])]

    # Distinct strings by anchor and owner; those alone at their anchor are done with.
    ranked = np.lexsort((least, anchor))
    sizes = np.array([b - a for a, b in parts_of(anchor[ranked])], np.int64)
    several = np.repeat(sizes, sizes) > 1
    rank = np.arange(len(ranked)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - rank - 1
    ranked, rank, left = ranked[several], rank[several], left[several]
    string_start, string_size = starts[region[first]] + low[first], size[first]
    before = np.cumsum(string_size[ranked] + 1) - string_size[ranked] - 1
    heads = np.flatnonzero(rank == 0)
    part = np.repeat(before[heads] // most, np.diff(np.append(heads, len(ranked))))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in parts_of(part):
        kept, streamed = ranked[a:b][left[a:b] > 0], ranked[a:b][rank[a:b] > 0]
        index = RunIndex(data, string_start[kept], string_size[kept], least[kept], match)
        string, at, held_by = index.owners_of_matches(data, string_start[streamed], string_size[streamed])
        earlier = held_by < least[streamed[string]]
        hits.append((streamed[string[earlier]], at[earlier]))
    if hits:
        string, at = (np.concatenate(column) for column in zip(*hits))
        # A string's matches hold for the regions of its own owner; later ones are covered as a whole.
        by_string = np.argsort(string, kind="stable")
        string, at = string[by_string], at[by_string]
        mine = np.flatnonzero(~whole)
        begin, end = np.searchsorted(string, number[mine], "left"), np.searchsorted(string, number[mine], "right")
        times = end - begin
        mine = np.repeat(mine, times)
        ends = np.cumsum(times)
        at = at[np.repeat(begin - (ends - times), times) + np.arange(len(mine))]
        found.append((region[mine], low[mine] + at, low[mine] + at + match))
    return joined(*(np.concatenate(column) for column in zip(*found)))


def joined(region: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping spans of a region as one, by region."""
    if not len(region):
        return region, start, end
    order = np.lexsort((start, region))
    region, start, end = region[order], start[order], end[order]
    # Regions one after the other on one line, far enough apart.
    base = region << 32
    reach = np.maximum.accumulate(base + end)
    first = np.flatnonzero(np.concatenate([[True], base[1:] + start[1:] > reach[:-1]]))
    return region[first], start[first], reach[np.append(first[1:] - 1, len(region) - 1)] - base[first]


def region_anchors(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, place, hash) of the anchors of all regions, found at once: grams and windows that cross regions don't count."""
    bounds = np.cumsum(lengths)
    region = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(region)) - (bounds - lengths)[region]
    text = data[starts[region] + place].tobytes()
    hashes = gram_hashes(text, GRAM)
    width = match - GRAM + 1
    least = sliding(hashes, width, np.minimum)
    least[place[: len(least)] + match > lengths[region[: len(least)]]] = 0
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((hashes == most) & (place[: len(hashes)] + GRAM <= lengths[region[: len(hashes)]]))
    return region[at], place[at], hashes[at].view(np.int64)


def content_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string, from hashes of prefixes of all bytes."""
    factor = np.uint64(FACTOR)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=0)), factor, np.uint64)]), dtype=np.uint64)
    values = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(31)
    found = np.zeros(len(starts), np.uint64)
    for step in range(len(powers) - 1):
        going = sizes > step
        found[going] += values[starts[going] + step] * powers[step]
    return (found ^ (found >> np.uint64(32))).view(np.int64)


def marked(docs: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    """(at, mark, text, block): keys that are never null; the lowest bit of the mark says that the id is missing."""
    id_ = F.col(id_col).cast("long")
    mark = F.xxhash64(text_col).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(id_.isNull().cast("long"))
    texts = docs.select(F.coalesce(id_, F.lit(LAST_ID)).alias("at"), mark.alias("mark"), F.col(text_col).alias("text"))
    return texts.withColumn("block", F.pmod(F.xxhash64("at", "mark"), F.lit(count)).cast("int"))


def repeated_spans(
    texts: DataFrame, size: int, match: int = MATCH, hot_places: int = HOT_PLACES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(block, refs, starts, ends): the byte spans to remove from the documents of a block, of ``size`` bytes of text."""
    if match <= GRAM:
        raise ValueError("a match must be longer than an anchor")
    answers, buckets = answered(texts, size, match, hot_places)
    # The totals are computed beside the answers: a checkpoint of these would have the texts shuffled again.
    totals = answers.agg(F.sum("places").alias("all_places"), F.sum("hot").alias("all_hot"))
    asked = answers.drop("places", "hot").crossJoin(F.broadcast(totals))
    send = send_regions(buckets, size, match, bucket_bytes)
    regions = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(send, REGIONS)
    return regions.groupBy("bucket").applyInArrow(answer_regions(match), SPANS)


def answered(texts: DataFrame, size: int, match: int, hot_places: int) -> tuple[DataFrame, int]:
    """(block, bucket, shared, groups), a row per block and bucket of hashes at most; and how many buckets there are."""
    # A hash costs about sixteen bytes in a task.
    buckets = max(1, -(-size * 32 // ((match - GRAM + 2) * HASH_BUCKET)))
    hashes = texts.groupBy("block").applyInArrow(send_hashes(buckets, match), HASHES)
    return hashes.groupBy("bucket").applyInArrow(answer_hashes(hot_places), ANSWERS), buckets


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    match: int = MATCH,
    with_kept: bool = False,
    hot_places: int = HOT_PLACES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of ``docs``."""
    size = total_bytes(docs, text_col)
    # Every stage that needs texts reads them from one exchange by block.
    texts = marked(docs, id_col, text_col, max(1, -(-size // BLOCK)))
    spans = repeated_spans(texts, size, match, hot_places, bucket_bytes)

    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        _, table = in_order(table)
        found = [
            (climbed(row["refs"], np.uint32), numbers(row["starts"], np.uint32), numbers(row["ends"], np.uint32))
            for row in spans.to_pylist()
        ]
        ref, start, end = joined(*(np.concatenate(c) for c in zip(*found))) if found else np.zeros((3, 0), np.int64)
        cuts = np.stack([start, end], 1)
        ids, marks = (table.column(n).to_pylist() for n in ("at", "mark"))
        texts_ = text_bytes(table.column("text"))
        low = np.searchsorted(ref, np.arange(len(texts_) + 1)).tolist()
        rows = []
        for i, text in enumerate(texts_):
            kept, cut = text, cuts[low[i] : low[i + 1]]
            if len(cut):
                bounds = [0, *cut.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            row = (None if marks[i] & 1 else ids[i], len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept) if with_kept else row)
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    names = [part.split()[0] for part in schema.split(", ")]
    return texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, schema)
