"""Operators on texts against brute force, and their defined results."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetgrid import session
from fleetgrid.llm import bottomk, lattice, packing, repeats, seeds
from fleetgrid.llm.bottomk import near_duplicates
from fleetgrid.llm.fertility import Band, fertility
from fleetgrid.llm.lattice import Lattice, first_weights, lattice_scores, vocabulary_pieces
from fleetgrid.llm.linechunks import chunks, remove_repeated_chunks
from fleetgrid.llm.packing import best_pattern, pack, solve
from fleetgrid.llm.queries import vocabulary
from fleetgrid.llm.repeats import remove_repeats
from fleetgrid.llm.rindex import RunIndex
from fleetgrid.llm.seeds import contaminated, without_contaminated

WORDS = re.compile("[^\x20\x09-\x0d]+")
PIECES = vocabulary("piece_bpe_32k.model")
TOKENS = vocabulary("word_bpe_49k.json")


def prose(rng, n, words=400):
    names = [f"w{rng.randrange(words)}" for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ".\n", ","]) for w in names)


@pytest.fixture(scope="module")
def corpus():
    """Prose with copies, near copies, repeated passages, odd characters, empty and blank texts."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[7] + " tail", "intro " + texts[9]]
    for k in (12, 13):
        words = texts[k].split(" ")
        words[len(words) // 2 : len(words) // 2 + 1] = ["changed"]
        texts.append(" ".join(words))
    texts += ["", " \n\t", "Ünïcode — straße 漢字 \x1c mixed", None, "A" * 3000, "a b " * 60, texts[5] + "\n" + texts[6]]
    return list(enumerate(texts))


def test_fertility_base_columns(documents, corpus):
    found = {r.doc_id: r for r in fertility(documents(*corpus), PIECES).collect()}
    assert len(found) == len(corpus)
    for doc, text in corpus:
        words = WORDS.findall(text or "")
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        row = found[doc]
        assert (row.n_words, row.word_chars, row.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert (row.n_repeat_words, row.base_failed) == (len(covered), failed)
        assert row.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert not (row.base_failed and row.kept)


def test_fertility_measures_and_bands(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "the quick brown fox jumps over the lazy dog again and again 漢字 ☃ " * 3 + "while many other words follow here now"
    ids = [i for word in text.split() for i in model.encode(word)]
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
    tight = {"en": Band(100.0, 200.0, 1.0, 0.0)}
    row = fertility(documents((1, text)), PIECES, tight, most_repeat_percent=100).first()
    assert row.n_tokens == len(ids)
    assert row.chars_per_token == pytest.approx(sum(map(len, text.split())) / len(ids))
    assert row.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
    assert row.token_entropy == pytest.approx(entropy)
    assert not row.kept and not row.base_failed
    # Two characters of 67 pieces need bytes: too many for English, not for another language in Latin script.
    assert not fertility(documents((1, text)), PIECES, most_repeat_percent=100).first().kept
    assert fertility(documents((1, text, "nl")), PIECES, most_repeat_percent=100).first().kept
    # A language without a band falls to its script; a script without one to "none".
    cyrillic = "слово " * 3 + "ещё много разных слов идёт дальше без повторов и конца сегодня здесь потом снова завтра лето зима"
    assert fertility(documents((1, cyrillic, "ru")), PIECES).first().script == "cyrillic"


def test_masks_are_lossless():
    for lost in itertools.combinations(range(seeds.WINDOW), seeds.SUBSTITUTIONS):
        assert any(
            not any(start + offset in lost for offset in mask)
            for mask in seeds.MASKS
            for start in range(seeds.WINDOW - mask[-1])
        )
    # Three neighbours survive a fifth of substitutions in every shorter item.
    for size in range(6, seeds.WINDOW):
        for lost in itertools.combinations(range(size), size // 5):
            assert any(not {s, s + 1, s + 2} & set(lost) for s in range(size - 2))


def agrees(doc, item):
    """Most agreeing words over all windows of a document and an item."""
    width = min(len(item), seeds.WINDOW)
    best = -1
    for a in range(len(doc) - width + 1):
        for b in range(len(item) - width + 1):
            best = max(best, sum(x == y for x, y in zip(doc[a : a + width], item[b : b + width])))
    return best


@pytest.mark.parametrize("most", [200_000, 0])
def test_contaminated_equals_brute_force(spark, documents, monkeypatch, most):
    """With the seeds broadcast, and with all sides shuffled."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    items = [(i, [f"t{rng.randrange(60)}" for _ in range(n)]) for i, n in enumerate([40, 16, 15, 9, 6, 5, 3, 2, 25])]
    items.append((20, items[0][1]))
    docs = []
    for k in range(60):
        words = [f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        item = rng.choice(items)[1]
        part = list(item[rng.randrange(0, min(3, len(item))) :])
        for _ in range(rng.randrange(0, 5)):
            part[rng.randrange(len(part))] = "new"
        at = rng.randrange(len(words) + 1)
        docs.append((k, words[:at] + part + words[at:]))
    docs.append((70, [f"t{rng.randrange(60)}" for _ in range(4000)] + items[8][1]))
    texts = [(k, ", ".join(w).upper()) for k, w in docs] + [(None, " ".join(items[0][1])), (90, None), (91, "")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(30, None), (31, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(documents(*texts), bench).collect()}
    wanted = {}
    for k, words in [*docs, (None, items[0][1])]:
        for i, item in items[:9]:
            n = len(item)
            allowed = 3 if n >= 16 else n // 5 if n >= 6 else 0
            most = agrees(words, item)
            if n >= 3 and most >= min(n, 16) - allowed:
                wanted[k, i] = most
    assert {pair: row.matched_words for pair, row in got.items()} == wanted
    assert len(wanted) > 20
    assert {row.item_copies for pair, row in got.items() if pair[1] == 0} == {2}
    left = {r.doc_id for r in without_contaminated(documents(*texts), bench).collect()}
    assert left == {k for k, _ in texts} - {k for k, _ in wanted}


def side_by_side(strings):
    """Bytes of all strings, and where each starts and how long it is."""
    lengths = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths


@pytest.mark.parametrize("seed", range(12))
def test_run_index_equals_search(seed):
    """Strings streamed against an index of others: the smallest owner of every long match."""
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"ab\x00\xff", b"abcdefgh"])
    some = lambda n: bytes(rng.choice(letters) for _ in range(n))
    bases = [some(120) for _ in range(3)]
    cut = lambda a: rng.choice(bases)[a : a + rng.randrange(50)] + some(rng.randrange(6))
    indexed, streamed = ([cut(rng.randrange(80)) for _ in range(rng.randrange(1, 60))] for _ in range(2))
    owners = np.array([rng.randrange(50) for _ in indexed])
    match = rng.choice([1, 3, 8, 20])
    found = RunIndex(*side_by_side(indexed), owners, match).owners_of_matches(*side_by_side(streamed))
    wanted = set()
    for i, string in enumerate(streamed):
        for at in range(len(string) - match + 1):
            held_by = [o for s, o in zip(indexed, owners.tolist()) if string[at : at + match] in s]
            wanted |= {(i, at, min(held_by))} if held_by else set()
    assert set(zip(*(column.tolist() for column in found))) == wanted


def test_run_index_compresses_repetition():
    """A thousand copies with few changes have few runs a symbol."""
    rng = random.Random(2)
    base = bytes(rng.choice(b"abcdefghijklmnop") for _ in range(80))
    strings = [base[:k] + bytes([65 + n % 7]) + base[k + 1 :] for n, k in enumerate(rng.randrange(80) for _ in range(1000))]
    index = RunIndex(*side_by_side(strings), np.arange(1000), 50)
    assert len(index.starts) < 0.1 * 81 * 1000


def test_anchors_of_long_texts(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = repeats.anchors(text, 50)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    for a, b in zip(whole, repeats.anchors(text, 50)):
        assert a.tolist() == b.tolist()


def repeats_by_search(rows, match):
    first = {}
    for doc, data in rows:
        for at in range(len(data) - match + 1):
            part = data[at : at + match]
            first[part] = min(first.get(part, doc), doc)
    for doc, data in rows:
        cut = bytearray(len(data))
        for at in range(len(data) - match + 1):
            if first[data[at : at + match]] < doc:
                cut[at : at + match] = b"\1" * match
        kept = bytes(b for b, c in zip(data, cut) if not c)
        spans = sum(1 for i, c in enumerate(cut) if c and not (i and cut[i - 1]))
        yield doc, len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest()


def test_repeats_equal_search(documents, corpus):
    rows = [*corpus, (100, "z" * 500), (101, "z" * 120 + "y"), (102, "x" + corpus[3][1][:60]), (103, "same id"), (103, corpus[4][1])]
    got = sorted(tuple(r)[:5] for r in remove_repeats(documents(*rows)).collect())
    assert got == sorted(repeats_by_search([(k, (t or "").encode()) for k, t in rows], 50))


@pytest.mark.parametrize(("hot", "bucket"), [(0, 8_000_000), (3, 2_000), (10**9, 500)])
def test_hot_anchors_are_split(documents, hot, bucket):
    """One line of 25 bytes in documents that differ around it, some sharing more: the anchor is dealt out by strings of 50 bytes."""
    rng = random.Random(12)
    line, some = "a line that all documents share", lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    sides = [some(60) for _ in range(5)]
    rows = [(k, some(40) + rng.choice(sides)[rng.randrange(40) :] + line + rng.choice(sides)[: rng.randrange(40)] + some(40)) for k in range(120)]
    rows += [(500, ""), (501, None), (502, line), (503, rows[3][1] + "ü" * 30), (504, "ü" * 40)]
    got = sorted(tuple(r) for r in remove_repeats(documents(*rows).repartition(3), hot_places=hot, bucket_bytes=bucket).collect())
    assert got == sorted(repeats_by_search([(k, (t or "").encode()) for k, t in rows], 50))
    assert sum(r[2] > 0 for r in got) > 50


@pytest.mark.parametrize("hot", [4_000, 2])
def test_repeats_across_blocks(documents, corpus, monkeypatch, hot):
    """Many blocks and buckets: each pair of them exchanges one row at most, however many documents a block has."""
    rng = random.Random(21)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [some(rng.randrange(45, 200)) for _ in range(20)]
    rows = [(k, some(rng.randrange(90)) + rng.choice(passages) + some(rng.randrange(90)) + rng.choice(passages)) for k in range(-40, 260)]
    rows += [(1000 + k, t) for k, t in corpus] + [(2000, rows[7][1]), (2000, rows[7][1]), (2000, rows[9][1][5:]), (2001, None)]
    docs = documents(*rng.sample(rows, len(rows)))
    monkeypatch.setattr(repeats, "BLOCK", 9_000)
    monkeypatch.setattr(repeats, "HASH_BUCKET", 4_000)
    size = sum(len((t or "").encode()) for _, t in rows)
    blocks = -(-size // 9_000)
    answers, buckets = repeats.answered(repeats.marked(docs, "doc_id", "text", blocks), size, 50, hot)
    assert blocks > 5 and buckets > 5 and blocks < answers.count() <= blocks * buckets
    got = sorted(tuple(r) for r in remove_repeats(docs, hot_places=hot, bucket_bytes=5_000).collect())
    assert got == sorted(repeats_by_search([(k, (t or "").encode()) for k, t in rows], 50))
    assert len({r[2] for r in got}) > 50


def test_rows_between_blocks_and_buckets_are_few(documents, monkeypatch):
    """Buckets follow the shared anchors, not all bytes, and several are one row; strings around hot anchors are dealt by hash."""
    rng = random.Random(33)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = "a line that all documents share"
    passages = [some(150) for _ in range(30)]
    rows = [(k, some(rng.randrange(300, 600)) + line + some(30) + rng.choice(passages)) for k in range(400)]
    docs = documents(*rows)
    monkeypatch.setattr(repeats, "BLOCK", 9_000)
    monkeypatch.setattr(repeats, "WIDE_GROUPS", 2)
    size = sum(len(t) for _, t in rows)
    blocks = -(-size // 9_000)

    def spied(*args):
        task = send_regions(*args)

        def run(table, answers):
            sent = task(table, answers)
            assert sent.num_rows <= 200
            return sent

        return run

    send_regions = repeats.send_regions
    monkeypatch.setattr(repeats, "send_regions", spied)
    got = sorted(tuple(r) for r in remove_repeats(docs, hot_places=100, bucket_bytes=1_000).collect())
    assert got == sorted(repeats_by_search([(k, t.encode()) for k, t in rows], 50))
    # As many buckets as the bytes of all texts would fill were some 900 for regions and 1,600 for strings.
    assert blocks > 20 and size * 100 // (32 * 1_000) > 600 and sum(r[2] > 0 for r in got) > 300
    few = repeats.region_buckets(10, 0, size, 50, 1_000)
    assert few == (1, 1, 1) and repeats.region_buckets(10**9, 0, size, 50, 1_000)[0] == -(-size * 100 // 32 // 1_000)


def test_repeats_without_id_come_last(documents, corpus):
    text = next(t for _, t in corpus if t and len(t) > 100)
    got = {r.doc_id: r.n_removed for r in remove_repeats(documents((5, text), (None, text))).collect()}
    assert got[5] == 0 and got[None] == len(text.encode())
    top = (1 << 63) - 1
    rows = remove_repeats(documents((top, text), (None, text + "!"), (7, "short"))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (7, 0), (top, 0)]


def test_repeats_with_clashing_columns(spark, corpus):
    text = next(t for _, t in corpus if t and len(t) > 100)
    docs = spark.createDataFrame([(1, text, 5, "x", 3), (2, text, 6, "y", 4)], "doc_id long, text string, at long, mark string, spans int")
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()) == [(1, 0), (2, len(text.encode()))]


def chunk_removal(rows):
    """What stays of each row, chunk by chunk in (id, place) order."""
    seen, left = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        kept = []
        for a, b in chunks((text or "").encode()):
            part = "\n".join(lines[a:b])
            if b - a > 1 and part in seen:
                continue
            if b - a > 1:
                seen.add(part)
            kept += lines[a:b]
        left[doc] = None if text is None else "\n".join(kept)
    return left


def test_line_chunks(documents):
    rng = random.Random(2)
    pool = [f"line {i} {rng.random()}" for i in range(60)]
    rows = []
    for doc in range(30):
        a = rng.randrange(40)
        rows.append((doc, "\n".join(pool[a : a + rng.randrange(1, 20)] + [f"own {doc}"] * (doc % 3))))
    rows += [(40, ""), (41, None), (42, "x\n" * 100), (43, "x\n" * 100), (44, "one line"), (45, "one line")]
    found = remove_repeated_chunks(documents(*rows)).collect()
    assert {r.doc_id: r.text for r in found} == chunk_removal(rows)
    assert sum(r.n_removed_chunks for r in found) > 5
    assert all(r.n_kept_lines == (0 if not r.n_lines else len(r.text.split("\n")) if r.n_removed_chunks < r.n_chunks else 0) for r in found)


def test_line_chunks_repeated_rows_and_clashing_columns(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 7, "a"), (1, text, 7, "a"), (2, text, 8, "b"), (None, text, 9, "c")], "doc_id long, text string, n_lines int, at string")
    found = sorted((r.doc_id or 99, r.n_kept_lines, r.at) for r in remove_repeated_chunks(docs).collect())
    single = sum(b - a for a, b in chunks(text.encode()) if b - a == 1)
    assert found == [(1, 30, "a"), (1, 30, "a"), (2, single, "b"), (99, single, "c")]


def passage_removal(rows):
    """What stays when every later occurrence of line runs with over 50 words goes, by comparing all pairs of runs."""
    texts = {doc: text.split("\n") for doc, text in rows}
    runs = {}
    for doc, lines in sorted(texts.items()):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = lines[a:b]
                if sum(len(line.split()) for line in run) > 50 and run[0].split() and run[-1].split():
                    runs.setdefault("\n".join(run), []).append((doc, a, b))
    gone = set()
    for places in runs.values():
        doc, _, end = places[0]
        gone |= {(d, at) for d, a, b in places[1:] if d != doc or a >= end for at in range(a, b)}
    return {doc: "\n".join(line for at, line in enumerate(lines) if (doc, at) not in gone) for doc, lines in texts.items()}


def test_shared_passages_of_different_documents(documents):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [[line(60)], [line(30), line(30)], [line(9), "", line(20), line(40)], [line(12) for _ in range(8)], [line(20), line(20)]]
    rows = []
    for doc in range(30):
        parts = [[line(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 5))]
        parts.insert(rng.randrange(len(parts) + 1), shared[doc % 5])
        rows.append((doc, "\n".join(text for part in parts for text in part)))
    rows += [(40, "\n".join(["twenty words " * 10] * 7)), (41, ""), (42, line(60) + "\n\n" + line(2))]
    found = {r.doc_id: r for r in remove_repeated_chunks(documents(*rows), passages=True).collect()}
    # Passages of 40 words, and one that repeats itself, may also go by chunks.
    expected = passage_removal(rows)
    for doc, text in rows:
        if doc % 5 != 4 and doc != 40:
            assert found[doc].text == expected[doc], doc
    for doc in range(5, 30):  # later copies of passages of over 50 words went whole
        if doc % 5 != 4:
            assert not any(text and text in found[doc].text.split("\n") for text in shared[doc % 5])
    whole = {r.doc_id: r.n_kept_lines for r in remove_repeated_chunks(documents(*rows)).collect()}
    assert sum(found[doc].n_kept_lines < whole[doc] for doc in range(5, 30)) > 10


def components_by_search(rows, width, percent=80):
    sets = {}
    for doc, text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
        sets[doc] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    parent = {doc: doc for doc in sets}

    def top(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {(doc, len(s), top(doc), top(doc) == doc) for doc, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_all_pairs(documents, corpus, width):
    rng = random.Random(width)
    base = [f"v{i}" for i in range(120)]
    rows = list(corpus)
    for k in range(40):  # one group in which many pairs lie on either side of the threshold
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(120)] = f"n{rng.randrange(1000)}"
        rows.append((1000 + k, " ".join(words)))
    got = {tuple(r) for r in near_duplicates(documents(*rows), width).collect()}
    assert got == components_by_search(rows, width)


def test_outsiders_alone_are_sent_to_blocks(spark, documents, monkeypatch):
    """One member apart in a hot list is sent, not the list; small blocks and copies give the same result."""
    rows = [(7, n, 10, 1) for n in range(1, 500)] + [(7, 900, 10, 900)] + [(8, n, 10, 1) for n in range(1, 40)]
    lists = bottomk.outsiders(spark.createDataFrame(rows, "value long, node long, size long, part long"))
    sent = bottomk.visits(lists, F.pmod("node", F.lit(5)).alias("block")).collect()
    assert {(r.node, r.block) for r in sent} == {(900, block) for block in range(5)} and len(sent) == 5
    assert all(r["values"] == [7] for r in sent)

    groups = []

    def spied(percent):
        task = block_links(percent)

        def run(sent, block):
            if sent.num_rows > 8:
                raise ValueError(f"{sent.num_rows} sets were sent to one task")
            return task(sent, block)

        groups.append(percent)
        return run

    block_links = bottomk.block_links
    monkeypatch.setattr(bottomk, "PAIRED", 1)
    monkeypatch.setattr(bottomk, "BLOCK_NODES", 6)
    monkeypatch.setattr(bottomk, "SENT_NODES", 2)
    monkeypatch.setattr(bottomk, "block_links", spied)
    rng = random.Random(3)
    rows = []
    for k in range(60):  # chains around the threshold, so that leaders leave links open
        words = [f"v{i}" for i in range(60)]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(60)] = f"n{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    assert {tuple(r) for r in near_duplicates(documents(*rows), 2).collect()} == components_by_search(rows, 2)
    assert groups


def test_long_lists_are_listed_by_two_values(documents, monkeypatch):
    """Documents that share common word pairs but no link: lists of two values leave few pairs, and no block."""
    rng = random.Random(8)
    common = [f"c{i} d{i}" for i in range(40)]
    rows = []
    for k in range(240):
        parts = rng.sample(common, 3) + [f"own{rng.randrange(10**6)} x{rng.randrange(10**6)}" for _ in range(6)]
        rng.shuffle(parts)
        rows.append((k, " ".join(parts)))
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(0, 240, 7)]
    pairs, blocks = [], []

    def spied(found, *args):
        pairs.append(found.count())
        return confirmed(found, *args)

    confirmed, visits = bottomk.confirmed, bottomk.visits
    monkeypatch.setattr(bottomk, "confirmed", spied)
    monkeypatch.setattr(bottomk, "visits", lambda *args: blocks.append(1) or visits(*args))
    monkeypatch.setattr(bottomk, "FEW", 4)
    monkeypatch.setattr(bottomk, "PAIRED", 6)
    assert {tuple(r) for r in near_duplicates(documents(*rows), 2).collect()} == components_by_search(rows, 2)
    assert len(pairs) == 2 and pairs[1] < 500 and not blocks


def test_near_duplicates_defined_results(spark, documents):
    text = "one two three four five six"
    rows = near_duplicates(documents((None, text), (3, text), (3, "other words"), (4, ""), (5, None)), 2).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows) == [
        (0, 5, None, True), (3, 1, 3, True), (3, 5, 3, True), (4, 0, 4, True), (5, 0, 5, True),
    ]
    assert near_duplicates(documents().limit(0), 2).count() == 0


def test_packing(documents, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENS)
    rows = [*corpus, (200, prose(random.Random(1), 9000)), (201, "It's <|endoftext|> don't"), (201, "It's <|endoftext|> don't")]
    found = pack(documents(*rows), TOKENS, with_ids=True).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[doc], key=lambda r: r.start)[:: 2 if doc == 201 else 1]
        assert [i for r in parts for i in r.ids] == ids
        for r in parts:
            assert r.doc_tokens == len(ids) and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert len(by_doc[201]) == 2
    used = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_words_encode_as_in_running_text():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENS)
    rng = random.Random(9)
    letters = "aabcdeeinorstZ'',.-_$0193éÀßÿÝ×÷漢ß \x1c\xa0\t<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["I'll they're it's WE'D <|endoftext|> a<|startoftext|>b <|END|> ÀÉ'S", "İstanbul ǅ ﬁne e\u0301 ½ ² ªº µ", "x" * 3000]
    assert packing.cuts_as_known(tokenizer)
    with packing.word_ids(TOKENS) as codes:
        for text in texts:
            found, _ = codes.tokens(codes.numbers(text.encode().split()))
            assert found.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert codes.numbers([]).tolist() == []
    assert not codes.index and len(codes.parts) == 1


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(4.5, 1, 50_000).astype(int) % 512 + 1, 511)
    sizes, demand = np.unique(lengths, return_counts=True)
    patterns = solve(sizes, demand, 512)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all((p * sizes).sum() <= 512 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.01 * (sizes * demand).sum() / 512 + 1
    values = rng.random(6)
    items = np.array([3, 5, 7, 11, 13, 17])
    worth, pattern = best_pattern(items, values, 40)
    best = max(sum(v * c for v, c in zip(values, combo)) for combo in itertools.product(*(range(40 // s + 1) for s in items)) if (np.array(combo) * items).sum() <= 40)
    assert worth == pytest.approx(best) and (pattern * items).sum() <= 40 and worth == pytest.approx((pattern * values).sum())


def test_ranking_does_not_depend_on_salts(documents, corpus, monkeypatch):
    docs = documents(*[r for r in corpus if r[1]])
    monkeypatch.setattr(packing, "RANKED_ROWS", 5)
    found = pack(docs, TOKENS).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found) == docs.count()


def all_segmentations(text, pieces):
    if not text:
        yield []
    for end in range(1, len(text) + 1):
        if text[:end] in pieces:
            for rest in all_segmentations(text[end:], pieces):
                yield [pieces[text[:end]], *rest]


def test_lattice_sums_all_segmentations():
    weights = first_weights(PIECES)
    lattice = Lattice(PIECES, weights)
    names = {name: i for i, name in enumerate(vocabulary_pieces(PIECES)[0]) if name}
    for word in ("the", "tionnes", "häuser", "a"):
        ways = list(all_segmentations("▁" + word, names))
        total = sum(math.exp(sum(weights[i] for i in way)) for way in ways)
        assert lattice.forward(word.encode()) == pytest.approx(math.log(total))
        counts = [0.0] * len(weights)
        lattice.expect(word.encode(), 2.0, counts)
        expected = Counter()
        for way in ways:
            for i in way:
                expected[i] += 2 * math.exp(sum(weights[j] for j in way)) / total
        assert {i: pytest.approx(c) for i, c in expected.items()} == {i: counts[i] for i in np.flatnonzero(counts)}
    assert math.isfinite(lattice.forward("☃漢".encode())) and math.isfinite(lattice.forward(b"x" * 5000))


def test_lattice_words_are_split_by_arrow():
    """The words of bytes that Python splits and lowers, for slices too."""
    rng = random.Random(3)
    parts = [" ", "\t", "\n", "\v", "\f", "\r", "\x00", "\x1c", "\x1f", "\x85", "\u00a0", "\u2003", "A", "zÜ", "\u0130", "q", "\ufeff"]
    texts = ["", " ", "\n\n", "a", " a", "a ", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500))]
    for part in (texts, texts[3:200], texts[:1], []):
        array = pa.array(texts + ["end"], pa.string()).slice(texts.index(part[0]) if part else 0, len(part))
        words, each = lattice.split_lower(array)
        wanted = [text.encode().lower().split() for text in array.to_pylist()]
        assert words.to_pylist() == [w for ws in wanted for w in ws] and each.tolist() == [len(ws) for ws in wanted]
    found = lattice.words_of_source(pa.table({"text": pa.array(texts), "source": pa.array([4] * len(texts), pa.int64())}))
    assert sorted(found.column("word").to_pylist()) == sorted({b"", *(w for t in texts for w in t.encode().lower().split())})


def test_lattice_scores(documents, corpus):
    rows = [*corpus, (None, "THE end"), (3, corpus[8][1])]
    found = lattice_scores(documents(*rows), PIECES).collect()
    words = [[w.lower() for w in (t or "").encode().split()] for _, t in rows]
    out = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    counts = Counter(w for ws, o in zip(words, out) if not o for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    wanted = Counter(
        (k, o, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]), 6))
        for (k, _), ws, o in zip(rows, words, out)
    )
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == wanted
    assert any(out) and all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_lattice_model_learns(documents):
    """Trained weights score held-out text of the same kind higher than the first weights do."""
    rng = random.Random(4)
    stems = ["zorb", "quix", "plome", "vask"]
    rows = [(k, " ".join(rng.choice(stems) + rng.choice(["ing", "ed", "tion"]) for _ in range(80))) for k in range(80)]
    found = lattice_scores(documents(*rows), PIECES).filter("held_out").collect()
    lattice = Lattice(PIECES, first_weights(PIECES))
    texts = dict(rows)
    for r in found:
        before = sum(lattice.forward(w.encode()) for w in texts[r.doc_id].split()) / math.log(10)
        assert r.score > before
    assert found


def test_empty_tables(documents, spark):
    none = documents().limit(0)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert fertility(none, PIECES).count() == 0
    assert contaminated(none, bench).count() == 0
    assert contaminated(documents((1, "a b c d e f")), bench.limit(0)).count() == 0
    assert remove_repeats(none).count() == 0
    assert lattice_scores(none, PIECES).count() == 0
    assert remove_repeated_chunks(none).count() == 0
    assert pack(none, TOKENS).count() == 0
    assert remove_repeated_chunks(none).filter(F.col("text").isNull()).count() == 0
