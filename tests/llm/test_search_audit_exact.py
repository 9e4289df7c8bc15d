"""Ranked search, filter audit and exact dedup against brute force, and their defined results."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgrid import session
from fleetgrid.llm import exact, impacts, survival
from fleetgrid.llm.exact import exact_groups, golomb_decoded, golomb_encoded, normalised, without_copies
from fleetgrid.llm.impacts import Best, ImpactList, best_positions, build_index, search
from fleetgrid.llm.survival import Rules, filter_audit, positional_popcounts

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# --- ranked search ---


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def ranking(docs, items, k=10):
    """The contract, document by document."""
    listed = [(doc, Counter(terms(text)), len(terms(text))) for doc, text in docs]
    n, total = sum(1 for *_, size in listed if size), sum(size for *_, size in listed)
    df = Counter(term for _, counts, _ in listed for term in counts)
    found = []
    for item, text in items:
        scored = []
        for doc, counts, size in listed:
            score = 0
            for term in terms(text):
                if tf := counts[term]:
                    mark = 100 - 75 + 75 * size * n // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 8 * mark))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        found += [(item, rank, None if missing else doc, -score) for rank, (score, missing, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "ß", "E", "x1"]
    make = lambda n: " ".join(rng.choice(words).upper() if rng.random() < 0.2 else words[min(int(rng.expovariate(0.1)), 64)] for _ in range(n))
    docs = [(k, make(rng.randrange(1, 60))) for k in range(150)]
    docs += [(200 + k, docs[5][1]) for k in range(30)]  # ties beyond the tenth
    docs += [(300, ""), (301, None), (302, " .,;\x1c "), (303, "w1-w2_w3\x7fw1"), (None, docs[7][1]), (None, docs[5][1]), (7, docs[7][1]), (304, "w0 " * 4000)]
    items = [(k, make(12)) for k in range(15)] + [(90, docs[5][1]), (91, ""), (92, None), (93, "unknown words only"), (94, "w1 w1 W1 w2"), (5, make(6))]
    return docs, items


@pytest.mark.parametrize(("block", "passes"), [(8_000_000, 1), (300, 1), (1500, 4)])
def test_search_equals_scoring_every_document(spark, documents, library, folder, monkeypatch, block, passes):
    docs, items = library
    size = sum(len((text or "").encode()) for _, text in items)
    monkeypatch.setattr(impacts, "ITEM_BYTES", -(-size // passes))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    index = build_index(documents(*docs).repartition(3), folder, block=block)
    got = sorted((tuple(r) for r in search(index, bench).collect()), key=str)
    # Two items share the id 5: each has its own ranks.
    assert got == ranking(docs, items)


def test_search_with_other_k(spark, documents, library):
    docs, items = library
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = build_index(documents(*docs), block=500)
    assert sorted(map(tuple, search(index, bench, 1).collect()), key=str) == ranking(docs, items, 1)
    assert sorted(map(tuple, search(index, bench, 500).collect()), key=str) == ranking(docs, items, 500)


def test_search_of_nothing(spark, documents):
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(build_index(documents().limit(0)), bench).count() == 0
    assert search(build_index(documents((1, None), (2, "..."))), bench).count() == 0
    assert search(build_index(documents((1, "a"))), bench.limit(0)).count() == 0
    assert [tuple(r) for r in search(build_index(documents((1, "A a"), (2, "b"))), bench).collect()] == ranking([(1, "A a"), (2, "b")], [(1, "a")])


def test_reading_stops_before_the_end_of_long_lists():
    """Few documents are far above the rest: their lists are left long before they end."""
    rng = np.random.default_rng(4)
    n = 20_000
    lists = []
    for _ in range(4):
        docs = np.sort(rng.choice(n, n // 2, replace=False))
        impact = rng.integers(1, 100, len(docs))
        impact[np.isin(docs, np.arange(20))] += 5000
        lists.append((3, ImpactList(docs, impact)))
    total = np.zeros(n, np.int64)
    for factor, held in lists:
        total[held.docs] += factor * held.impacts
    best = Best(10)
    scored = best_positions(lists, np.zeros(n, np.uint8), np.arange(n), best)
    assert [(-s, i) for s, _, i in best.held] == [(total[i], i) for i in np.lexsort((np.arange(n), -total))[:10]]
    assert scored < 1000
    # A block that can't reach the tenth score is left at once.
    assert best_positions([(1, lists[0][1])], np.zeros(n, np.uint8), np.arange(n), best) == 0


def test_length_marks_beyond_64_bits():
    lengths = np.array([10**9, 5], np.int64)
    assert impacts.length_marks(lengths, 10**10, 10**12).tolist() == [25 + 75 * 10**9 * 10**10 // 10**12, 25 + 75 * 5 * 10**10 // 10**12]


# --- filter audit ---


def audit(docs, labels, rules=Rules()):
    """The contract, order by order."""
    by_text = {}
    for doc, text, _ in docs:
        if doc is not None:
            by_text[text or ""] = min(doc, by_text.get(text or "", doc))
    good = {doc for doc, quality, _ in labels if quality == 1}
    toxic = {doc for doc, _, mark in labels if mark == 1}
    parts = {}
    for doc, text, lang in docs:
        text = text or ""
        words = WORDS.findall(text)
        least = by_text.get(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": least is not None and (doc is None or doc > least),
        }
        parts.setdefault(lang or "", []).append((doc, fails))
    rows, sums = [], Counter()
    for part, members in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, name in enumerate(order, 1):
                out = [m for m in left if m[1][name]]
                left = [m for m in left if not m[1][name]]
                sums[part, name] += len(out)
                failing = [m for m in members if m[1][name]]
                only = [m for m in failing if sum(m[1].values()) == 1]
                lost = [sum(m[0] in marked for m in out if m[0] is not None) for marked in (good, toxic)]
                rows.append((part, "".join(order), step, len(left), len(out), len(failing) - len(out), len(only), *lost, name))
    return sorted((*row[:-1], sums[row[0], row[-1]]) for row in rows)


def test_audit_equals_every_order(spark, documents):
    rng = random.Random(8)
    docs = []
    for k in range(160):
        n = rng.choice([0, 5, 199, 200, 230])
        vocabulary = [f"v{i}" for i in range(rng.choice([40, 99, 100, 400]))]
        words = [rng.choice(vocabulary) for _ in range(n)]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        text = " ".join(words) + rng.choice(["", "", "#", " 5% of & ünï"])
        docs.append((k, text, rng.choice(["en", "de", None, ""])))
    docs += [(200 + k, docs[3][1], "en") for k in range(20)] + [(400, None, "fr"), (401, "", "fr")]
    docs += [(None, docs[9][1], "de"), (None, "only without an id " * 60, "de"), (None, "only without an id " * 60, "de")]
    docs += [(3, docs[3][1], "en"), (3, "another text of document three", "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 230, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit(documents(*docs).repartition(5), marks).collect()))
    assert got == audit(docs, labels)
    assert len(got) == 4 * 600 and any(r[7] for r in got) and any(r[8] for r in got)


def test_audit_clashing_columns_and_no_rows(spark):
    rows = [(1, "a b", "en", "x", 1, 2, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, fails int, counts int, print string")
    marks = spark.createDataFrame([(1, 1, 0, "y")], "doc_id long, quality int, toxic int, part string")
    got = sorted(map(tuple, filter_audit(docs, marks).collect()))
    assert got == audit([(1, "a b", "en")], [(1, 1, 0)])
    assert filter_audit(docs.limit(0), marks).count() == 0
    assert filter_audit(docs, marks.limit(0)).filter("good_lost > 0").count() == 0


def test_audit_thresholds():
    rules = Rules()
    assert rules.failures(b" ".join(b"w%d" % i for i in range(200))) == 0
    assert rules.failures(b" ".join(b"w%d" % i for i in range(199))) == 1
    assert rules.failures(b"a b " * 100) == 2
    assert rules.failures(b" ".join(b"w%d w%d" % (i, i) for i in range(100))) == 0
    long_ = "é" * 97 + "ABC"
    assert rules.failures(long_.encode()) == 1 and rules.failures((long_ + "D").encode()) == 5
    assert rules.failures(b"|") == 9 and rules.failures(b"") == 1


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_positional_popcounts(words):
    wanted = [sum(w >> bit & 1 for w in words) for bit in range(32)]
    assert positional_popcounts(np.array(words, np.uint32)).tolist() == wanted


def test_words_are_truth_tables():
    for failed in range(32):
        assert [bool(survival.WORDS[failed] >> s & 1) for s in range(32)] == [not failed & s for s in range(32)]


# --- exact dedup ---


@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=200), st.integers(0, 50))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values, below):
    values = np.array(sorted(values), np.uint64)
    base = max(int(values[0]) - below, 0)
    assert golomb_decoded(golomb_encoded(values, base), base).tolist() == values.tolist()


def test_golomb_codes_are_short():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 22, 1 << 14).astype(np.uint64))
    # The bound for random sets is about 1.5 bits above the log of the mean gap.
    assert 8 * len(golomb_encoded(values, 0)) < (8 + 2.1) * len(values)


@given(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\xa0é", max_size=30))
@settings(max_examples=200, deadline=None)
def test_normalised_texts(text):
    assert normalised(text.encode()) == re.sub("[\x20\x09-\x0d]+", " ", text).encode()


def groups_by_search(rows):
    held = {}
    for at, (doc, text) in enumerate(rows):
        held.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append((doc is None, doc or 0, at))
    found = []
    for text, members in held.items():
        missing, keep, first = min(members)
        for gone, doc, at in members:
            found.append((None if gone else doc, None if missing else keep, len(members), at == first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    rows = list(enumerate(texts))
    rows += [(1000 + k, texts[4]) for k in range(200)]  # more than a third of all rows
    rows += [(500 + k, texts[rng.randrange(20)].replace(" ", rng.choice(["\n", "  ", "\t"]))) for k in range(60)]
    rows += [(700, texts[9] + " "), (701, " " + texts[9]), (702, ""), (703, None), (704, " \n"), (705, "\t"), (706, "a\xa0b"), (707, "a b")]
    rows += [(None, texts[11]), (None, "nobody"), (None, "nobody"), (3, texts[3]), (3, texts[3]), (3, "third"), (800, "x" * 400_000), (801, "x" * 400_000)]
    return rows


@pytest.mark.parametrize(("broadcast", "spare"), [(200_000, 8), (0, 8), (3, 8), (0, -7), (200_000, -7)])
def test_exact_groups_equal_search(documents, copies, monkeypatch, broadcast, spare):
    """Also where few or no fingerprints are broadcast, and where so few bits are sent that most texts meet by chance."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", max(broadcast, 1))
    docs = documents(*copies).repartition(7)
    assert sorted(map(tuple, exact_groups(docs, spare=spare).collect()), key=str) == groups_by_search(copies)


def test_copies_in_other_blocks_of_one_task(documents):
    """Blocks hold 4 MB of text: the copies of each text stand in two blocks."""
    rows = [(k, f"{k % 4} " + "y" * 1_500_000) for k in range(8)]
    assert sorted(map(tuple, exact_groups(documents(*rows).coalesce(1)).collect()), key=str) == groups_by_search(rows)


def test_suspects_are_what_rows_share(documents, copies):
    texts = Counter(normalised((text or "").encode()) for _, text in copies)
    for docs in (documents(*copies).coalesce(1), documents(*copies).repartition(5)):
        assert exact.suspects(docs.select("text"), 60, 64).count() == sum(n > 1 for n in texts.values())
    spread = documents((1, "a  b"), (2, "a b"), (3, "c"), (4, "d")).repartition(4, "doc_id")
    assert exact.suspects(spread.select("text"), 40, 64).count() == 1


def test_without_copies_keeps_whole_rows(spark):
    rows = [(1, "a b", "k", 5), (2, "a  b", "l", 6), (2, "a  b", "l", 6), (None, "c", "m", 7), (None, "c", "n", 8), (3, "d", "o", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, ids int")
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text, r.doc_id or 0) for r in kept.collect()) == [("a b", 1), ("c", 0), ("d", 3)]


def test_no_documents(documents):
    assert exact_groups(documents().limit(0)).count() == 0
