"""Queries of the corpus operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, katz, neardup, packing, quality, ranked, reshard, secrets, substrings, templates, urls
from .common import Scratch

TOKENIZER_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_items", "item_ids", "equal")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_chat(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + 8 + length(text)
    + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '### ', ''))) // 4
    + (length(text) - length(replace(text, '</turn>', ''))) // 7)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text) || ',', '(system,)?(user,assistant,)+') AS valid
FROM t GROUP BY conv_id"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), "n_live", "n_examples",
    )


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_read(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's shards: documents by their source, as uneven as sources are."""
    docs = _read(spark, sf_dir, "documents")
    today = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(40))
    return reshard.reshard(docs, today, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT rowid_ AS r, count(*) - count(DISTINCT line) AS n FROM (
    SELECT r AS rowid_, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM (SELECT row_number() OVER () AS r, text FROM documents))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rowid_),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
ww AS (SELECT r, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM ww WHERE len(words) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (
  SELECT ww.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    len(words) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(words) AS base_failed,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS letters_,
    length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS bangs_, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines_
  FROM ww LEFT JOIN lines ON lines.r = ww.r LEFT JOIN covered ON covered.r = ww.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * upper_ > letters_ OR 2 * bangs_ > n_words OR 100 * n_symbols > 20 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 40 * lines_) AS kept
FROM m"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"))


def url_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries that follow from the pages' hosts: every third host is listed at some day,
    most of these are taken off later, and some come back; half of the entries name the parent."""
    host = urls.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct().withColumn("h", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 8), 16, 10).cast("long"))
    entry = F.struct
    day = lambda x: F.date_add(F.lit("2024-01-01").cast("date"), x.cast("int")).cast("timestamp")
    pattern = F.when(F.col("h") % 2 == 0, F.col("host")).otherwise(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1))
    entries = F.array(
        entry((F.lit(True)).alias("listed"), day(F.col("h") % 150).alias("since")),
        entry((F.col("h") % 5 == 0).alias("listed"), day(150 + F.col("h") % 90).alias("since")),
        entry((F.col("h") % 7 == 0).alias("listed"), day(240 + F.col("h") % 60).alias("since")),
    )
    return hosts.where("h % 3 = 0").select(pattern.alias("pattern"), F.explode(entries).alias("e")).select("pattern", "e.listed", "e.since").where("pattern <> ''")


def op10_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 366 * 86400)
    captures = pages.withColumn("fetched_at", fetched)
    return urls.temporal_filter(captures, url_entries(pages)).select(
        "page_id", "host", F.unix_timestamp("fetched_at").alias("fetched_at"), "blocked", F.coalesce("rule", F.lit("")).alias("rule")
    )


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, (1704067200 + (page_id * 7919) % 366 * 86400)::BIGINT AS fetched_at,
    lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host
  FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
h AS (SELECT *, CASE WHEN h % 2 = 0 THEN host ELSE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) END AS pattern FROM hosts WHERE h % 3 = 0),
entries AS (
  SELECT pattern, true AS listed, 1704067200 + (h % 150) * 86400 AS since FROM h
  UNION ALL SELECT pattern, h % 5 = 0, 1704067200 + (150 + h % 90) * 86400 FROM h
  UNION ALL SELECT pattern, h % 7 = 0, 1704067200 + (240 + h % 60) * 86400 FROM h),
one AS (SELECT pattern, since, bool_or(listed) AS listed FROM entries WHERE pattern <> '' GROUP BY pattern, since),
spells AS (SELECT * FROM (SELECT pattern, listed, since AS valid_from, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS valid_to FROM one) WHERE listed),
hits AS (
  SELECT page_id, max_by(pattern, length(pattern)) AS rule FROM p JOIN spells
    ON (p.host = pattern OR p.host LIKE '%.' || pattern) AND p.fetched_at >= valid_from AND (valid_to IS NULL OR p.fetched_at < valid_to)
  GROUP BY page_id)
SELECT p.page_id, host, fetched_at, rule IS NOT NULL AS blocked, coalesce(rule, '') AS rule FROM p LEFT JOIN hits ON hits.page_id = p.page_id"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.index(_read(spark, sf_dir, "documents"), Scratch(spark))
    return ranked.search(index, _read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM lowered),
s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
items AS (
  SELECT row_number() OVER () AS i, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark),
asked AS (SELECT i, item_id, unnest(terms) AS term FROM items),
posts AS (
  SELECT r, doc_id, len_, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS len_, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posts, s GROUP BY term),
impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len_ * n) // l))) AS impact
  FROM posts JOIN w USING (term), s),
scores AS (SELECT i, item_id, r, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50"""


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(_read(spark, sf_dir, "pages"))


#: For the layout of the given pages: an article of headings and paragraphs, with the four references they use.
OP12_SQL = r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT r, regexp_split_to_array(body, '</?(?:p|h1)>') AS parts FROM a)),
c AS (
  SELECT r, i, trim(regexp_replace(replace(replace(replace(replace(
    regexp_replace(replace(part, '<br>', ' '), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS line
  FROM b),
t AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM c WHERE line <> '' GROUP BY r),
h AS (SELECT regexp_extract(coalesce(url, ''), '://([^/?#:]*)', 1) AS host, count(*) AS n FROM a GROUP BY 1)
SELECT a.page_id, a.url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars, h.n >= 3 AS templated
FROM a LEFT JOIN t USING (r) JOIN h ON h.host = regexp_extract(coalesce(url, ''), '://([^/?#:]*)', 1)"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECE_FILE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_chat": op2_chat,
        "op3_secrets": op3_secrets,
        "op4_katz": op4_katz,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_reshard": op6_reshard,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_substrings": op9_substrings,
        "op10_url_list": op10_url_list,
        "op11_ranked_search": op11_ranked_search,
        "op12_extraction": op12_extraction,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op7_quality": OP7_SQL, "op10_url_list": OP10_SQL, "op11_ranked_search": OP11_SQL, "op12_extraction": OP12_SQL}
