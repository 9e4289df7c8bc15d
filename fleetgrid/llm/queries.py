"""The dealt operators over the benchmark tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import table
from fleetgrid.llm.bottomk import near_duplicates
from fleetgrid.llm.exact import exact_groups
from fleetgrid.llm.fertility import fertility
from fleetgrid.llm.impacts import build_index, search
from fleetgrid.llm.lattice import lattice_scores
from fleetgrid.llm.linechunks import remove_repeated_chunks
from fleetgrid.llm.packing import pack
from fleetgrid.llm.quotes import linked_conversations
from fleetgrid.llm.repeats import remove_repeats
from fleetgrid.llm.seeds import contaminated
from fleetgrid.llm.separators import token_counts, write_token_files
from fleetgrid.llm.survival import filter_audit
from fleetgrid.llm.warc import deduplicate_archive, page_records, read_archive, revisits, write_archive
from fleetgrid.session import work_folder

# Folder of the public vocabularies, the same on every host; unset, the installed package names their places.
VOCABULARIES = os.environ.get("PUBLIC_VOCABULARIES")

# Written into the archives, so that two runs give the same bytes.
ARCHIVE_DATE = "2024-01-01T00:00:00Z"


def vocabulary(name: str) -> str:
    if VOCABULARIES:
        return f"{VOCABULARIES}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility measures and verdict per document."""
    return fertility(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the byte strings of earlier ones."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under the smoothed unigram and the lattice model."""
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without globally repeated chunks of lines."""
    kept = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return kept.selectExpr(
        "doc_id", "n_lines", "n_kept_lines", "n_chunks", "n_removed_chunks", "md5(text) AS kept_md5"
    )


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, found in flat token files; files are numbered by their names."""
    path = work_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), path)
    counts = token_counts(spark, path)
    part = F.regexp_extract("file", "part-(\\d+)-[^/]*$", 1).cast("int").alias("part")
    piece = F.regexp_extract("file", "-c(\\d+)\\.[^/]*$", 1).cast("int").alias("piece")
    return counts.select(part, piece, "document", "start", "n_tokens", "ended")


def op7_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record type, payload and original of every page in the deduplicated archives."""
    full, deduplicated = work_folder(spark, "archive"), work_folder(spark, "deduplicated")
    write_archive(page_records(table(spark, sf_dir, "pages")), full, ARCHIVE_DATE)
    deduplicate_archive(spark, full, deduplicated, ARCHIVE_DATE)
    return revisits(read_archive(spark, deduplicated))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with near-equal shingle sets."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotes, with their thread and what they reply to."""
    return linked_conversations(table(spark, sf_dir, "conversations"))


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op12_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in every order, per language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, and whether it stays, of every document among those with the same text."""
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_fertility,
        op2_spaced_seeds,
        op3_run_length_index,
        op4_subword_lattice,
        op5_line_chunks,
        op6_separator_scan,
        op7_cutting_stock,
        op8_revisits,
        op9_bottom_k,
        op10_quotation_links,
        op11_best_position,
        op12_survival_words,
        op13_golomb_exchange,
    )
}

SQL: dict[str, str] = {}

SQL["op5_line_chunks"] = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), rolled AS (
  SELECT *, ((h + 31 * lag(h, 1, 0) OVER w + 961 * lag(h, 2, 0) OVER w) // 65536) % 4 = 0 AS ends
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM rolled
), cut AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1) // 32 AS part FROM runs
), chunks AS (
  SELECT doc_id, run, part, min(i) AS pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM cut GROUP BY ALL
), judged AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) > 1 AS gone FROM chunks
)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines,
  coalesce(sum(n) FILTER (NOT gone), 0)::BIGINT AS n_kept_lines,
  count(pos) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
  CASE WHEN any_value(d.text) IS NOT NULL THEN
    md5(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '')) END AS kept_md5
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""

SQL["op8_revisits"] = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), digests AS (
  SELECT page_id, payload, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS original FROM payloads
), groups AS (
  SELECT page_id, payload, original, list_transform(range(0, 8), lambda g: ('0x' || substr(h, 1 + 5 * g, 5))::INTEGER) AS bits FROM digests
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((bits[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM groups
"""

SQL["op3_run_length_index"] = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), bytes AS (
  SELECT doc_id, i, n, hex(array_slice(b, i + 1, i + 1)) AS c, CASE WHEN i <= n - 50 THEN array_slice(b, i + 1, i + 50) END AS s
  FROM (SELECT *, unnest(range(n)) AS i FROM d)
), first AS (
  SELECT s, min(doc_id) AS first FROM bytes WHERE s IS NOT NULL GROUP BY s
), starts AS (
  SELECT b.doc_id, b.i, b.c, max(CASE WHEN first < b.doc_id THEN b.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i) AS last
  FROM bytes b LEFT JOIN first USING (s)
), judged AS (
  SELECT doc_id, i, c, coalesce(i - last < 50, false) AS gone FROM starts
), spans AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM judged
)
SELECT d.doc_id, any_value(d.n)::BIGINT AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
  sha256(unhex(coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""

SQL["op2_spaced_seeds"] = r"""
WITH signs AS (
  SELECT '[\x00-/:-@\[-`{-\x{bf}\x{d7}\x{f7}\x{2000}-\x{206f}\x{2190}-\x{2bff}\x{3000}-\x{303f}\x{ff00}-\x{ff0f}\x{ff1a}-\x{ff20}]+' AS sign
), item_lists AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), sign), lambda w: w <> '') AS words FROM benchmark, signs
), items AS (
  SELECT words, min(item_id) AS item_id, count(*) AS item_copies FROM item_lists WHERE len(words) >= 3 GROUP BY words
), docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), sign), lambda w: w <> '') AS words FROM documents, signs
), item_words AS (
  SELECT item_id, item_copies, len(words) AS n, unnest(range(len(words))) AS i, unnest(words) AS word FROM items
), doc_words AS (
  SELECT doc_id, len(words) AS m, unnest(range(len(words))) AS j, unnest(words) AS word FROM docs
), agreeing AS (
  SELECT doc_id, item_id, item_copies, n, least(n, 16) AS width, j - i AS shift, i,
    greatest(0, i - j) AS low, least(n - least(n, 16), m - least(n, 16) - (j - i)) AS high
  FROM item_words JOIN doc_words USING (word)
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS c
  FROM agreeing WHERE low <= high
), best AS (
  SELECT doc_id, item_id, item_copies, n, width, shift,
    greatest(coalesce(max(c) FILTER (i BETWEEN low AND high), 0), count(*) FILTER (i >= high AND i < high + width)) AS matched
  FROM counted GROUP BY ALL
  UNION ALL
  SELECT doc_id, min(item_id), count(*), len(d.words), len(d.words), 0, len(d.words)
  FROM docs d JOIN item_lists l ON d.words = l.words WHERE len(d.words) BETWEEN 1 AND 2 GROUP BY doc_id, d.words
)
SELECT doc_id, item_id, item_copies, width::INTEGER AS window_words, max(matched)::INTEGER AS matched_words
FROM best WHERE matched >= width - CASE WHEN n >= 16 THEN 3 WHEN n >= 6 THEN n // 5 ELSE 0 END
GROUP BY ALL
"""

SQL["op9_bottom_k"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s)
    WHERE x.doc_id < y.doc_id GROUP BY ALL
  ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT reached.doc_id, b FROM reached JOIN both_ways ON other = a
), least AS (
  SELECT doc_id, min(other) AS component FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
  coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

SQL["op11_best_position"] = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), totals AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM terms
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM terms)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term), totals GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

SQL["op12_survival_words"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), judged AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM texts
), marked AS (
  SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM judged LEFT JOIN labels USING (doc_id)
), tallied AS (
  SELECT part, concat(CASE WHEN fails['A'] THEN 'A' ELSE '' END, CASE WHEN fails['B'] THEN 'B' ELSE '' END,
    CASE WHEN fails['C'] THEN 'C' ELSE '' END, CASE WHEN fails['D'] THEN 'D' ELSE '' END, CASE WHEN fails['E'] THEN 'E' ELSE '' END) AS f,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM marked GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS l, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), outcomes AS (
  SELECT part, filter_order, step, l, n, good, bad, f, contains(f, l) AS hit,
    len(list_intersect(string_split(f, ''), string_split(before, ''))) > 0 AND f <> '' AND before <> '' AS gone
  FROM tallied, steps
), counted AS (
  SELECT part, filter_order, step, l,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (f = l), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM outcomes GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counted
"""

SQL["op13_golomb_exchange"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""
