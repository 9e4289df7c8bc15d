"""Token files, archives, quotations and the pipeline, on small fixtures."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from fleetgrid.llm import quotes, seeds, separators
from fleetgrid.llm.queries import vocabulary
from fleetgrid.llm.quotes import linked_conversations
from fleetgrid.llm.separators import token_counts, write_token_files
from fleetgrid.llm.warc import (
    deduplicate_archive,
    field,
    page_records,
    read_archive,
    resolved,
    revisits,
    write_archive,
)

DATE = "2024-02-03T04:05:06Z"
PIECES = vocabulary("piece_bpe_32k.model")


# --- token files ---


def documents_of(ids, end):
    """(start, length, ended) of each document of a file, one id after the other."""
    found, start = [], 0
    for at, token in enumerate(ids):
        if token == end:
            found.append((start, at - start, True))
            start = at + 1
    return found + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.fixture
def small_splits(spark):
    """Files are read in ranges of 24 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "24")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize(("block", "end"), [(1, 2), (1000, 2), (3, 0x0100), (7, 0x0205), (7, 0xC450), (3, 0x0202), (1, 0xFFFF)])
def test_documents_are_found_across_blocks_and_splits(spark, folder, small_splits, block, end):
    rng = np.random.default_rng(block)
    Path(folder).mkdir()
    files = {
        "a": rng.integers(0, 6, 97),
        "b": np.array([2, 2, 2]),
        "c": np.array([7, 8, 9]),
        "d": np.array([], int),
        # The bytes of the end id, but not at the place of an id.
        "e": np.array([0x0200, 0x0005, 0x0200, 2]),
        "f": rng.choice([end, end & 0xFF, end >> 8, (end >> 8) | (end & 0xFF) << 8, 0x0202, 7], 300),
        "g": np.full(80, end),
        "h": np.full(70, 9),
    }
    for name, ids in files.items():
        (Path(folder) / name).write_bytes(ids.astype("<u2").tobytes())
    scanned = separators.scanned_blocks(spark, folder, end, block)
    assert scanned.filter("file LIKE '%/f'").select("split").distinct().count() > 5
    found = {}
    for r in token_counts(spark, folder, end, block).collect():
        found.setdefault(r.file[-1], {})[r.document] = (r.start, r.n_tokens, r.ended)
    for name, ids in files.items():
        assert [found.get(name, {})[k] for k in sorted(found.get(name, {}))] == documents_of(ids.tolist(), end)


def test_half_an_id_is_an_error(spark, folder):
    Path(folder).mkdir()
    (Path(folder) / "a").write_bytes(b"\x07\x00\x02\x00\x09")
    with pytest.raises(Exception, match="half an id"):
        token_counts(spark, folder).collect()


def test_no_token_files(spark, documents, folder):
    write_token_files(documents().limit(0), PIECES, folder)
    assert token_counts(spark, folder).count() == 0


def test_written_token_files_hold_every_document(spark, documents, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["one two", "", None, "Straße 漢字 \n\n x", "</s> \x02\x00", "word " * 500, "one two"]
    write_token_files(documents(*enumerate(texts)), PIECES, folder)
    counts = sorted(r.n_tokens for r in token_counts(spark, folder, block_tokens=64).collect())
    assert counts == sorted(sum(len(model.encode(w)) for w in (t or "").split()) for t in texts)
    raw = b"".join(p.read_bytes() for p in sorted(Path(folder).glob("part-*")))
    ids = np.frombuffer(raw, "<u2")
    assert (ids == 2).sum() == len(texts) and ids.max() < 32_000


# --- archives ---

PAGE = "page_id long, url string, html string"


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://a/1", "<p>same ü</p>"),
        (2, "http://a/2", "<p>other</p>"),
        (9, "http://a/9", "<p>same ü</p>"),
        (5, None, "<p>same ü</p>"),
        (6, "http://a/6\r\nX-Page-Id: 77", ""),
        (7, "http://a/7", None),
        (8, "http://a/8", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nend\r\n\r\n"),
        (10, "http://a/10", "text\r\n\r\n"),
        (None, "http://a/none", "<p>other</p>"),
        (11, "http://a/11", "x" * 200_000),
        (12, "http://a/12", "x" * 200_000),
    ]
    return spark.createDataFrame(rows, PAGE).repartition(3)


def wanted_pages(rows, least=0):
    for r in rows:
        data = (r.html or "").encode()
        twins = [o.page_id for o in rows if (o.html or "") == (r.html or "") and o.page_id is not None]
        top = max(twins) if twins else None
        again = len(data) >= least and r.page_id != top
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        yield (r.page_id, len(data), digest, "revisit" if again else "response", top if again else None)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive_round_trip(spark, pages, folder, compression):
    records = page_records(pages)
    write_archive(records, folder, DATE, compression)
    found = read_archive(spark, folder)
    names = ["page_id", "record_type", "record_id", "url", "payload_digest", "payload_bytes"]
    key = [*names, F.md5("payload").alias("payload")]
    as_rows = lambda df: sorted(map(str, df.select(*key).collect()))
    assert as_rows(found) == as_rows(records)
    raw = [p.read_bytes() for p in Path(folder).glob("part-*")]
    text = b"".join(gzip.decompress(b) if compression == "gzip" else b for b in raw)
    assert text.count(b"WARC-Date: 2024-02-03T04:05:06Z\r\n") == 11 and text.endswith(b"\r\n\r\n")


def test_fields_are_cut_without_patterns(spark):
    """The value behind the first line start with the name, up to any line end, found without a search by pattern."""
    heads = ["A: 1\r\nB: 2", "\r\nA: 1\nx\r\nA: 2", "xA: 1", "\nA: 1", "\r\nA: \r\nA: 2", "\r\nA:  \rz", "A: A: 3", "", "\r\nAA: 1\r\nA: ü: é"]
    found = spark.createDataFrame([(n, h) for n, h in enumerate(heads)], "n int, head string").select("n", field(F.col("head"), "A").alias("a"))
    wanted = [(re.search("(?:^|\r\n)A: ([^\r\n]*)", h) or [None, None])[1] or None for h in heads]
    assert [r.a for r in found.orderBy("n").collect()] == wanted
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_archives_are_compressed_fast(spark, folder):
    rows = [(n, f"u{n}", " ".join(str(n * k % 997) for k in range(300))) for n in range(300)]
    write_archive(page_records(spark.createDataFrame(rows, PAGE).coalesce(1)), folder, DATE)
    raw = b"".join(p.read_bytes() for p in Path(folder).glob("part-*.gz"))
    fast = len(zlib.compress(gzip.decompress(raw), 1))
    assert abs(len(raw) - fast) < 0.02 * fast


@pytest.mark.parametrize("least", [0, 6, 20])
def test_revisits_point_to_the_largest_page(spark, pages, folder, least):
    write_archive(page_records(pages), folder, DATE)
    deduplicate_archive(spark, folder, folder + "_new", DATE, least)
    found = sorted(map(tuple, revisits(read_archive(spark, folder + "_new")).collect()), key=str)
    assert found == sorted(wanted_pages(pages.collect(), least), key=str)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_payloads_of_marks_are_put_together(spark, folder, compression):
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(name, "3000")
    rng = random.Random(4)
    record = "\r\n\r\nWARC/1.1\r\nContent-Length: "
    parts = ["\r\n\r\nWARC/1.1\r\n", "\r\n\r\nWARC/1.1", "\r\n", "WARC/1.1\r\n", "ü", "", f"{record}2147483647\r\n\r\nx", f"{record}9\r\n\r\nx", f"{record}x\r\n\r\n"]
    rows = [(n, f"u{n}", "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for n in range(120)]
    rows += [(200 + n, "u", text) for n, text in enumerate(parts)]
    records = page_records(spark.createDataFrame(rows, PAGE).repartition(3))
    write_archive(records, folder, DATE, compression)
    found = sorted((r.page_id, bytes(r.payload).decode(), r.record_id) for r in read_archive(spark, folder).collect())
    assert found == sorted((r.page_id, bytes(r.payload).decode(), r.record_id) for r in records.collect())
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def test_same_page_twice_stays_a_response(spark, folder):
    rows = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (0, "v", "a")], PAGE)
    verdicts = resolved(page_records(rows)).select("page_id", "record_type").collect()
    assert sorted(map(tuple, verdicts)) == [(0, "revisit"), (1, "response"), (1, "response")]


def test_no_pages(spark, folder):
    write_archive(page_records(spark.createDataFrame([], PAGE)), folder, DATE)
    assert read_archive(spark, folder).count() == 0


# --- quotations ---

MESSAGE = "conv_id long, turn long, role string, text string"
A = "How do I bake bread at home?\nI have flour and water."
B = "Mix them well and wait.\n\nThen bake it for an hour."


@pytest.fixture
def chat(spark):
    rows = [
        (1, 0, "user", A),
        (1, 1, "assistant", B),
        (1, 2, "user", "On Monday Ann wrote:\n> Mix them WELL,\n> and wait.\n\nFor how long should I wait?"),
        (1, 3, "user", "> How do I bake bread at home? I have flour\n> and water.\nAnother idea: buy it."),
        (1, 4, "assistant", ">> Mix them well and wait.\n> For how long should I wait?\n\nTwo hours."),
        (1, 5, "user", "> nobody ever said this line here\n\nOdd."),
        (1, 6, "user", "Thanks, that is all.\r\nBye."),
        (2, 0, "user", "> Mix them well and wait.\nNot from this conversation."),
        (3, 0, "user", None),
        (3, 1, "user", ""),
        (None, 0, "user", "> no conversation"),
        (4, 1, "user", "Same place, first text"),
        (4, 1, "user", "Same place, second text"),
        (4, 2, "user", "> Same place, second text\nreply"),
        (5, 1, "user", "> written later than this\nearly"),
        (5, 2, "user", "written later than this"),
    ]
    return spark.createDataFrame(rows, MESSAGE)


@pytest.mark.parametrize("bucket", [1, 2, 1024])
def test_quotes_link_to_the_messages_they_quote(chat, monkeypatch, bucket):
    monkeypatch.setattr(quotes, "TURN_BUCKET", bucket)
    found = {(r.conv_id, r.turn, r.text): r for r in linked_conversations(chat).collect()}
    assert len(found) == 16
    by_turn = {r.turn: r for r in found.values() if r.conv_id == 1}
    assert [by_turn[n].reply_to for n in range(7)] == [None, None, 1, 0, 2, None, None]
    assert [by_turn[n].thread for n in range(7)] == [0, 1, 1, 0, 1, 5, 6]
    assert by_turn[4].ancestors == [2, 1]
    assert [by_turn[n].text for n in (2, 3, 4, 5)] == [
        "For how long should I wait?",
        "Another idea: buy it.",
        "Two hours.",
        "Odd.",
    ]
    assert by_turn[0].text == A and by_turn[6].text == "Thanks, that is all.\r\nBye."
    others = {(c, t): r for (c, t, _), r in found.items() if c != 1}
    assert others[2, 0].reply_to is None and others[2, 0].text == "Not from this conversation."
    assert others[3, 0].text is None and others[3, 1].text == ""
    assert others[None, 0].thread == 0 and others[None, 0].text == ""
    assert others[4, 2].reply_to == 1 and others[4, 2].thread == 1
    assert others[5, 1].reply_to is None


def test_latest_earlier_message_is_meant(spark):
    line = "the very same line of text"
    rows = [(1, n, "user", line) for n in range(6)] + [(1, 6, "user", f"> {line}\nyes")]
    rows += [(1, n, "user", f"> {line}\nagain {n}") for n in range(7, 40)]
    found = {r.turn: r for r in linked_conversations(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert {found[n].reply_to for n in range(6, 40)} == {5}


def test_short_passages_link_to_the_messages_that_hold_them(spark):
    rows = [
        (1, 0, "user", "Thanks"),
        (1, 1, "user", "はい、そうです。"),
        (1, 2, "user", "First of all: yes\nYes, do\nand something else"),
        (1, 3, "user", "> Thanks\nWelcome"),
        (1, 4, "user", "> はい、そうです\n好的"),
        (1, 5, "user", "> Yes, do\nI did"),
        (1, 6, "user", "> nothing said here\n> Thanks\nPart of another text"),
        (1, 7, "user", "> !!\nNo words"),
        (2, 0, "user", "> Thanks\nOther conversation"),
    ]
    found = {(r.conv_id, r.turn): r for r in linked_conversations(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert [found[1, n].reply_to for n in range(3, 8)] == [0, 1, 2, None, None]
    assert [found[1, n].thread for n in range(3, 8)] == [0, 1, 2, 6, 7]
    assert found[2, 0].reply_to is None


def test_long_chains_have_one_thread(spark):
    rows = [(1, 0, "user", "message number zero here")]
    rows += [(1, n, "user", f"> message number {'zero' if n == 1 else n - 1} here\n\nmessage number {n} here") for n in range(1, 30)]
    found = linked_conversations(spark.createDataFrame(rows, MESSAGE)).collect()
    assert {r.thread for r in found} == {0}
    assert {r.turn: r.reply_to for r in found} == {n: n - 1 if n else None for n in range(30)}


def plain(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ")


def cut_units(text):
    """(level, plain text) of every line, paragraph and passage of a message that counts."""
    lines = []
    for line in re.split("\r?\n", text):
        marks = re.match("[ \t]*>[> \t]*", line)
        lines.append((marks[0].count(">"), line[marks.end() :]) if marks else (0, line))
    found = {(level, plain(body), False) for level, body in lines}
    for level, passage in itertools.groupby(lines, key=lambda line: line[0]):
        bodies = [body for _, body in passage]
        found.add((level, plain(" ".join(bodies)), True))
        starts = [0, *(n for n, body in enumerate(bodies) if not body.strip(" ")), len(bodies)]
        found |= {(level, plain(" ".join(bodies[i:k])), False) for i, k in zip(starts, starts[1:])}
    found.add((0, plain(" ".join(body for level, body in lines if not level)), True))
    return {(level, words) for level, words, whole in found if words and (whole or not level or len(words) >= 8)}


def linked_by_search(rows):
    """(conv_id, turn) to (reply_to, ancestors, thread), every quoted unit sought in every earlier message."""
    units = collections.defaultdict(set)
    for conv, turn, _, text in rows:
        units[conv, turn] |= cut_units(text or "")
    links = {}
    for (conv, turn), own in units.items():
        votes = collections.defaultdict(collections.Counter)
        for level, words in own:
            holders = [t for (c, t), theirs in units.items() if c == conv and t < turn and (0, words) in theirs]
            if level and holders:
                votes[level][max(holders)] += len(words)
        best = [max(votes[level].items(), key=lambda vote: (vote[1], vote[0]))[0] for level in sorted(votes)]
        links[conv, turn] = (best[0] if best else None, best)

    def first(conv, turn):
        above = links[conv, turn][0]
        return turn if above is None else first(conv, above)

    return {key: (*link, first(*key)) for key, link in links.items()}


@pytest.mark.parametrize("seed, bucket", [(1, 4), (2, 1024)])
def test_links_equal_search(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(quotes, "TURN_BUCKET", bucket)
    rng = random.Random(seed)
    words = "yes no Bread flour OVEN für 好的 two! wait, again hour > -- 12".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5)))
    rows = []
    for conv in range(6):
        said = []
        for turn in range(50):
            parts = []
            for _ in range(rng.randrange(1, 4)):
                if said and rng.random() < 0.5:
                    quoted = rng.choice(said).split("\n")
                    start = rng.randrange(len(quoted))
                    mark = rng.choice(["> ", ">", ">> ", " > > "])
                    parts += [mark + rng.choice([str.upper, str])(q) for q in quoted[start : start + rng.randrange(1, 5)]]
                else:
                    parts += [line() for _ in range(rng.randrange(1, 4))]
            said.append("\n".join(parts))
            rows.append((conv, turn if rng.random() < 0.95 else max(turn - 1, 0), "user", said[-1]))
    found = linked_conversations(spark.createDataFrame(rows, MESSAGE)).collect()
    wanted = linked_by_search(rows)
    assert len(found) == len(rows)
    assert {(r.conv_id, r.turn): (r.reply_to, list(r.ancestors), r.thread) for r in found} == wanted
    assert sum(link[0] is not None for link in wanted.values()) > 60


def test_no_messages(spark):
    assert linked_conversations(spark.createDataFrame([], MESSAGE)).count() == 0


# --- pipeline ---


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("alpha bravo charlie delta echo foxtrot golf hotel india".split()) + str(rng.randrange(400)) for _ in range(n))
    clean = {k: "\n".join(prose(12) for _ in range(8)) for k in range(6)}
    item = prose(30)
    chunk = "\n".join(prose(10) for _ in range(24))
    near = prose(300)
    rows = [
        *clean.items(),
        (10, "too short"),
        (11, "again and again the same words here now " * 20),
        (12, f"{chunk}\n{prose(40)}"),
        (13, f"{chunk}\n{prose(40)}"),
        (14, near),
        (15, near.replace(near.split(" ")[150], "changed")),
        (16, f"{prose(30)} {item} {prose(30)}"),
        (17, None),
    ]
    docs = [(k, t, "xx", "s", len(t or "")) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r for r in frame.collect()})
    quality, lines, near_kept, last = kept
    assert set(quality) == {k for k, _ in rows} - {10, 11, 17}
    assert set(lines) == set(quality) and lines[12].text == dict(rows)[12]
    assert len(lines[13].text) < len(dict(rows)[13]) and lines[13].n_chars == len(lines[13].text)
    assert set(near_kept) == set(lines) - {15}
    assert set(last) == set(near_kept) - {16}
    assert all(last[k].text == clean[k] for k in clean)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(last)


def test_one_contaminated_text_without_id_takes_no_other_along(spark, documents):
    item = " ".join(f"item{n}" for n in range(30))
    bench = spark.createDataFrame([(1, item), (2, "Two words!"), (3, "one")], "item_id long, text string")
    rows = [(None, item), (None, "a clean text without an id"), (None, None), (5, "clean too"), (6, f"x {item}"), (7, "two words"), (8, "two words more"), (9, "One.")]
    left = seeds.without_contaminated(documents(*rows), bench).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str(rows[k]) for k in (1, 2, 3, 6))


def test_stages_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([(0, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int, row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, none, str(tmp_path))
        assert found.columns == none.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
