"""Registered queries of this subpackage: each operator on its whole table, in the agreed columns."""

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.sizing import scratch_path
from . import (
    bpe,
    chat,
    decontamination,
    fingerprints,
    language_model,
    licenses,
    manifest,
    neardup,
    negatives,
    quality,
    secrets,
    token_counts,
    warc,
)

COUNTED_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
# Control strings of our template inside texts: read back as they were.
HARD_TEXT = r"\### Assistant: </turn> ok"
HARD_CONVERSATION = -7


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def joined(array, separator=","):
    return F.array_join(array, separator)


def op1_secret_scan(spark, sf_dir):
    """One version of each document is scanned into a new ledger, and read from it."""
    versions = documents(spark, sf_dir).withColumnRenamed("doc_id", "path")
    ledger = scratch_path(spark, "secret-ledger")
    found = secrets.findings(secrets.update_ledger(versions, ledger), ledger)
    base = ("assign", "access", "hex")

    def of_kind(kind):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("bigint")

    def listed(found):
        return joined(
            F.transform(
                found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"])
            )
        )

    is_base = F.filter("found", lambda f: f["kind"].isin(*base))
    return found.select(
        F.col("path").alias("doc_id"),
        *[of_kind(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(listed(is_base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def op2_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(
        documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(joined("items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_quality_classifier(spark, sf_dir):
    return quality.resample(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_token_counts(spark, sf_dir):
    path = public_tokenizers.path(COUNTED_VOCABULARY)
    return token_counts.token_counts(documents(spark, sf_dir), path)


def op5_web_archive(spark, sf_dir):
    records = warc.archived_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_near_duplicates(spark, sf_dir):
    classes = neardup.near_duplicates(documents(spark, sf_dir))
    return classes.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_links",
    )


def op7_chat_formatting(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(HARD_CONVERSATION, i, r, HARD_TEXT) for i, r in enumerate(("user", "assistant"))],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return chat.read_back(
        chat.format_conversations(given.union(hard), look_back=chat.TURN_LOOK_BACK)
    )


def op8_license_scan(spark, sf_dir):
    found = licenses.license_scan(documents(spark, sf_dir))
    labels = F.array_sort(F.array_union("base_labels", "found_labels"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined("base_labels").alias("base_labels"),
        joined(labels).alias("labels"),
        "score",
    )


def op9_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_bpe_round_trip(spark, sf_dir):
    path = public_tokenizers.path(WORD_VOCABULARY)
    encoded = bpe.encode_documents(documents(spark, sf_dir), path).drop("text")
    ids = joined(F.col("ids").cast("array<string>"), " ")
    return bpe.decode_documents(encoded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark, sf_dir):
    """Every seventh label is moved on by one before mining; every hundredth row is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", moved.alias("label"), "embedding"
    )
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_language_model(spark, sf_dir):
    """Learns from the documents whose digest of the id leaves another remainder than 2."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model.score_texts(documents(spark, sf_dir), held_out)


def manifest_rows(documents, **options):
    """The manifest, verified with n_chars tampered with in about a seventh of the rows."""
    rows = manifest.manifest(
        documents,
        changed={"n_chars": F.try_add("n_chars", F.lit(1))},
        is_changed=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
        **options,
    )
    proof = F.sha2(manifest.proof(F.col("steps")), 256).alias("proof_sha256")
    return manifest.verified(rows).select(
        "doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified"
    )


def op13_merkle_manifest(spark, sf_dir):
    return manifest_rows(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_counts": op4_token_counts,
    "op5_web_archive": op5_web_archive,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_license_scan": op8_license_scan,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_model": op12_language_model,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# --- the same in SQL, where SQL can say it -------------------------------------------------------

# Windows of 13 words, or whole shorter items, are looked for at every word of every document.
_DECONTAMINATION_SQL = """
WITH item_words AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM item_words WHERE len(w) > 0)
),
document_words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM document_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
),
held AS (
  SELECT doc_id, i, p.n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words FROM places) p
  JOIN windows ON windows.words = p.words AND windows.n = p.n
),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM held) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM held) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM document_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# One rule's matches: the texts between matches and the matches themselves give their places.
_SECRET_RULES = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
        r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{6}""",
    ),
    ("access", "AKIA[A-Z0-9]+", "^.{20}"),
    ("hex", "[0-9a-f]+", "^.{24}"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "^."),
    ("github", "gh[pousr]_[A-Za-z0-9]+", "^.{40}"),
)


def _rule_sql(rank, kind, pattern, passes):
    # Greedy matches end where the last group does, and a failing one has under six characters.
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(found) AS stop
FROM (
  SELECT doc_id, found,
         list_sum([length(x) FOR x IN between[1 : i]]) +
         coalesce(list_sum([length(x) FOR x IN matches[1 : i - 1]]), 0) AS start
  FROM (SELECT doc_id, between, matches, unnest(matches) AS found,
               unnest(range(1, len(matches) + 1)) AS i
        FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS between,
                     regexp_extract_all(text, '{pattern}') AS matches FROM texts))
) WHERE regexp_matches(found, '{passes}')"""


_SECRETS_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_rule_sql(i, *rule) for i, rule in enumerate(_SECRET_RULES))}),
listed AS (
  SELECT doc_id, rank, kind, start, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS span
  FROM found
),
by_document AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM listed GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM texts t LEFT JOIN by_document USING (doc_id)
"""

_ESCAPED_LENGTH = r"""length(regexp_replace({0}, '\\|### |</turn>{1}', 'xx\0', 'g'))
  - (length({0}) - length(replace({0}, '\', '')))"""

_CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(14 + {_ESCAPED_LENGTH.format('role', '|: ')} + {_ESCAPED_LENGTH.format('text', '')})::BIGINT
         AS formatted_chars
FROM turns GROUP BY conv_id
"""

_NEGATIVES_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def _field_sql(column):
    text = f"{column}::VARCHAR"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf_sql(*columns):
    return f"sha256({' || '.join(map(_field_sql, columns))})"


# CRC-32 bit by bit over the digits of the number.
_CRC_SQL = """
  xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
      lambda c, bit: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

# Levels of all subtrees, then of the tree on their tops, whose leaves lie at level 1000.
_MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC_SQL} % 7 = 0
              THEN {_leaf_sql('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')} END AS tampered
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM leaves
),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1
  GROUP BY tree, level, pos // 2
),
subroots AS (
  SELECT tree, digest AS subroot, level FROM nodes
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level DESC) = 1
),
top_nodes AS (
  SELECT 0 AS level, tree AS pos, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM top_nodes) WHERE n > 1
  GROUP BY level, pos // 2
),
root AS (SELECT digest AS root, level AS height FROM top_nodes ORDER BY level DESC LIMIT 1),
steps AS (
  SELECT p.tree, p.pos, l.level AS step, n.pos % 2 = 0 AS is_left, n.digest
  FROM placed p JOIN subroots s USING (tree)
  JOIN (SELECT unnest(range(0, 64)) AS level) l ON l.level < s.level
  LEFT JOIN nodes n ON n.tree = p.tree AND n.level = l.level
    AND n.pos = CASE WHEN (p.pos >> l.level::INTEGER) % 2 = 0 THEN (p.pos >> l.level::INTEGER) + 1
                     ELSE (p.pos >> l.level::INTEGER) - 1 END
  UNION ALL
  SELECT p.tree, p.pos, 1000 + l.level, n.pos % 2 = 0, n.digest
  FROM placed p, root r
  JOIN (SELECT unnest(range(0, 64)) AS level) l ON l.level < r.height
  LEFT JOIN top_nodes n ON n.level = l.level
    AND n.pos = CASE WHEN (p.tree >> l.level::INTEGER) % 2 = 0 THEN (p.tree >> l.level::INTEGER) + 1
                     ELSE (p.tree >> l.level::INTEGER) - 1 END
),
paths AS (
  SELECT tree, pos, list(CASE WHEN is_left THEN digest ELSE '' END ORDER BY step) AS lefts,
         list(CASE WHEN NOT is_left THEN digest ELSE '' END ORDER BY step) AS rights,
         string_agg(digest, '' ORDER BY step) AS proof
  FROM steps GROUP BY tree, pos
),
folds AS (
  SELECT tree, pos, 0 AS i, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, i + 1, sha256(lefts[i + 1] || digest || rights[i + 1])
  FROM folds f JOIN paths q ON q.tree = f.tree AND q.pos = f.pos WHERE i < len(lefts)
),
folded AS (
  SELECT tree, pos, digest AS folded_root FROM folds
  QUALIFY row_number() OVER (PARTITION BY tree, pos ORDER BY i DESC) = 1
)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256,
       f.folded_root, f.folded_root = r.root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folded f ON f.tree = p.tree AND f.pos = p.pos
LEFT JOIN paths q ON q.tree = p.tree AND q.pos = p.pos, root r
"""

# Base 32 writes 20 bits, 5 hexadecimal digits, as 4 characters.
_PAGES_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_page
  FROM pages
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM payloads
"""


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _values(rows):
    return ", ".join(f"({', '.join(_quoted(v) for v in row)})" for row in rows)


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# Every pair of neighbouring words of a template counts in the blocks of 2 * step words around it.
_LICENSES_SQL = f"""
WITH phrases(phrase, label) AS (VALUES {_values(licenses.BASE_PHRASES)}),
texts AS (
  SELECT row_number() OVER () AS template, label, {_WORDS_SQL} AS w
  FROM (VALUES {_values(licenses.TEMPLATES)}) AS t(label, text)
),
template_pairs AS (
  SELECT DISTINCT template, label, [x FOR x IN [2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]
                                    IF 4 * x >= 5 * len(w)][1] AS step,
         unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS pair
  FROM texts
),
sized AS (SELECT *, count(*) OVER (PARTITION BY template) AS n_pairs FROM template_pairs),
document_words AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents
),
places AS (
  SELECT r, i - 1 AS place, w[i] || ' ' || w[i + 1] AS pair,
         w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS triple
  FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM document_words)
),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         list(DISTINCT label) AS labels
  FROM places JOIN phrases ON phrase = pair OR phrase = triple GROUP BY r
),
held AS (
  SELECT r, template, label, n_pairs, pair,
         unnest(list_distinct([place // step, greatest((place + 1) // step - 1, 0)])) AS block
  FROM places JOIN sized USING (pair)
),
found AS (
  SELECT r, label, count(DISTINCT pair) AS n, any_value(n_pairs) AS n_pairs
  FROM held GROUP BY r, template, label, block
),
method AS (
  SELECT r, max(n::DOUBLE / n_pairs) AS score, list(DISTINCT label) AS labels
  FROM found WHERE 10 * n >= 8 * n_pairs GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(
         coalesce(b.labels, []) || coalesce(m.labels, []))), ',') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM document_words d LEFT JOIN base b USING (r) LEFT JOIN method m USING (r)
"""

ORACLE = {
    "op1_secret_scan": _SECRETS_SQL,
    "op2_benchmark_decontamination": _DECONTAMINATION_SQL,
    "op5_web_archive": _PAGES_SQL,
    "op7_chat_formatting": _CHAT_SQL,
    "op8_license_scan": _LICENSES_SQL,
    "op11_hard_negatives": _NEGATIVES_SQL,
    "op13_merkle_manifest": _MANIFEST_SQL,
}
