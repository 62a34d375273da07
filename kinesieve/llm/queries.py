"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesieve.llm import bpe, bwt, jaccard, langid, linededup, merkle, packing, ppm, quality, tiling, topk, turns, warc
from kinesieve.llm.storage import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest_columns(lines_of: DataFrame) -> DataFrame:
    return lines_of.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, sf_dir, "pages")), keep=("page_id",))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(linededup.filter_lines(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths are their languages; a fifth of the labels is left out for testing."""
    trains = langid.remainder(F.col("doc_id"), 5) != 2
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), trains)


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "item_id", "coverage", F.sort_array(F.transform("leaks", lambda x: x.item_id)).alias("item_ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes go; has_passage tells of shorter ones, of about fifty words, that stay."""
    return bwt.remove_repeats(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _sql_decoded(text: str) -> str:
    names = " ".join(f"WHEN {k!r} THEN chr({ord(v)})" for k, v in warc.ENTITIES.items())
    number = r"coalesce(TRY_CAST(regexp_extract(p, '^#([0-9]{1,7});', 1) AS INTEGER), TRY_CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,6});', 1) AS INTEGER))"
    sound = f"(coalesce({number}, 0) BETWEEN 1 AND 55295 OR coalesce({number}, 0) BETWEEN 57344 AND 1114111)"
    name = "regexp_extract(p, '^([a-z]{2,6});', 1)"
    known = f"CASE {name} {names} END"
    return f"""array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p
      WHEN {sound} THEN chr(coalesce({number}, 32)) || regexp_replace(p, '^#[xX]?[0-9a-fA-F]{{1,7}};', '')
      WHEN {known} IS NOT NULL THEN {known} || substr(p, length({name}) + 2) ELSE '&' || p END), '')"""


def _sql_tidy(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '[ \t\r\f\x0b\x{{00A0}}]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_visible(html: str) -> str:
    inside = warc.INSIDE.replace("*+", "*").replace("'", "''")  # no backtracking there, so nothing to possess
    text = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for name in warc.HIDDEN:
        text = rf"regexp_replace({text}, '(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>', ' ', 'g')"
    text = rf"regexp_replace({text}, '[\r\n]+', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?(?:{warc.BREAKING})(?:[\s/]{inside}|>)', chr(10), 'g')"
    text = f"regexp_replace({text}, '</?[a-zA-Z!?]{inside}', '', 'g')"
    return text


def _sql_uuid(text: str) -> str:
    h = f"md5({text})"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"


CRLF = "chr(13) || chr(10)"
OP1_SQL = rf"""
WITH base AS (
  SELECT page_id, {_sql_uuid("'response ' || coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '')")} AS refers_to,
         url AS target_uri, '1970-01-01T00:00:00Z' AS date, coalesce(html, '') AS payload
  FROM pages),
stripped AS (SELECT *, {_sql_visible("payload")} AS bare,
         regexp_replace(regexp_extract(payload, '(?is)<title(?:\s[^>]*)?>(.*?)</title', 1), '[\r\n]+', ' ', 'g') AS raw_title,
         regexp_extract(payload, '(?is)<html\s[^>]*?lang\s*=\s*["'']?([a-zA-Z-]+)', 1) AS lang,
         len(string_split_regex(lower(payload), '<a\s[^>]*href')) - 1 AS links
  FROM base),
texts AS (SELECT *, {_sql_tidy(_sql_decoded("bare"))} AS text, {_sql_tidy(_sql_decoded("raw_title"))} AS title,
         'sha256:' || sha256(payload) AS source_digest FROM stripped),
both_ AS (
  SELECT page_id, 'metadata' AS type, refers_to, target_uri, date, 'application/warc-fields' AS content_type, source_digest,
         'source-payload-digest: ' || source_digest || {CRLF} || 'source-content-length: ' || strlen(payload) || {CRLF}
         || 'source-header: Content-Type: text/html; charset=utf-8' || {CRLF}
         || CASE WHEN title <> '' THEN 'title: ' || title || {CRLF} ELSE '' END
         || CASE WHEN lang <> '' THEN 'html-lang: ' || lang || {CRLF} ELSE '' END
         || 'outlinks: ' || links || {CRLF} AS block FROM texts
  UNION ALL
  SELECT page_id, 'conversion', refers_to, target_uri, date, 'text/plain', source_digest, text FROM texts),
out_ AS (
  SELECT *, {_sql_uuid("type || ' ' || refers_to")} AS record_id, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM both_)
SELECT page_id, type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest, source_digest, block,
       'WARC/1.1' || {CRLF} || 'WARC-Type: ' || type || {CRLF} || 'WARC-Record-ID: ' || record_id || {CRLF}
       || 'WARC-Refers-To: ' || refers_to || {CRLF} || CASE WHEN target_uri IS NOT NULL THEN 'WARC-Target-URI: ' || target_uri || {CRLF} ELSE '' END
       || 'WARC-Date: ' || date || {CRLF} || 'WARC-Block-Digest: ' || block_digest || {CRLF}
       || 'Content-Type: ' || content_type || {CRLF} || 'Content-Length: ' || content_length || {CRLF} AS headers
FROM out_
"""

OP3_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND f.keeper <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON s.doc_id = r.node
"""

def _sql_crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit: -1 stands for a shift, other numbers are bytes."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda b: [CAST(ord(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    bits = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, x: {bits}), 4294967295)"


WHITE = r"\x20\x09-\x0D"
OP11_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS pos FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^{WHITE}]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         regexp_extract(text, '([^{WHITE}])[{WHITE}]*$', 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY conv_id),
follows(state, role, after) AS (VALUES (0, 'system', 1), (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
one AS (SELECT * FROM follows WHERE role <> 'system'),
inserts AS (
  SELECT state, state AS after, '' AS audit, 0 AS cost, CAST([] AS VARCHAR[]) AS lines FROM (VALUES (0), (1), (2), (3)) AS x(state)
  UNION ALL SELECT state, after, 'I', 5, [role || ':'] FROM one
  UNION ALL SELECT a.state, b.after, 'II', 10, [a.role || ':', b.role || ':'] FROM one a JOIN one b ON b.state = a.after),
edits(edit, role) AS (VALUES ('D', ''), ('K', ''), ('R', 'user'), ('R', 'assistant')),
repairs AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM conversations
  UNION ALL
  SELECT conv_id, pos, state, min(best) FROM (
    SELECT r.conv_id, j.pos, CASE WHEN e.edit = 'D' THEN i.after ELSE f.after END AS state,
           {{'cost': r.best.cost + i.cost + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.edit <> 'D' AND j.cut THEN 5 ELSE 0 END,
            'audit': r.best.audit || i.audit || e.edit,
            'lines': list_concat(r.best.lines, i.lines, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [e.role || ':' || j.text] END)}} AS best
    FROM repairs r JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.pos = r.pos + 1
    JOIN inserts i ON i.state = r.state CROSS JOIN edits e
    LEFT JOIN follows f ON f.state = i.after AND (e.edit = 'K' AND left(f.role, 1) = j.initial OR e.edit = 'R' AND f.role = e.role)
    WHERE e.edit = 'D' OR (f.after IS NOT NULL AND NOT j.blank AND NOT j.again)) GROUP BY conv_id, pos, state),
ended AS (
  SELECT r.conv_id, min({{'cost': r.best.cost + i.cost, 'audit': r.best.audit || i.audit, 'lines': list_concat(r.best.lines, i.lines)}}) AS best
  FROM repairs r JOIN inserts i ON i.state = r.state AND i.after IN (0, 3)
  WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.pos = r.pos + 1) GROUP BY r.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit,
       sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM ended e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _sql_leaf(text: str) -> str:
    fields = [f"CAST({x} AS VARCHAR)" for x in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END" for x in fields) + ")"


def _sql_tree(leaves: str, levels: str) -> str:
    """The nodes above leaves(tree, idx, n, hash), a fanout of three."""
    return f"""{levels} AS (
  SELECT tree, 0 AS level, idx, n, hash FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM {levels} WHERE n > 1 GROUP BY tree, level, idx // 3, n)"""


def _sql_siblings(leaves: str, levels: str, shift: int) -> str:
    own = "a.idx // CAST(power(3, l.level) AS BIGINT)"
    return f"""SELECT a.tree, a.idx, l.level + {shift} AS level, coalesce(string_agg(l.hash, '' ORDER BY l.idx) FILTER (l.idx < {own}), '') AS before,
         coalesce(string_agg(l.hash, '' ORDER BY l.idx) FILTER (l.idx > {own}), '') AS behind
  FROM {leaves} a JOIN {levels} l ON a.tree = l.tree AND l.n > 1 AND l.idx // 3 = a.idx // CAST(power(3, l.level + 1) AS BIGINT) GROUP BY a.tree, a.idx, l.level"""


OP12_SQL = rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS tree, {_sql_leaf("text")} AS hash,
         CASE WHEN {_sql_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS claimed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_sql_tree("placed", "low")},
subroots AS (
  SELECT '' AS tree, tree AS name, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_sql_tree("subroots", "high")},
inner_ AS ({_sql_siblings("placed", "low", 0)}),
outer_ AS ({_sql_siblings("subroots", "high", 1000)}),
paths AS (
  SELECT tree, idx, level, before, behind FROM inner_
  UNION ALL
  SELECT p.tree, p.idx, o.level, o.before, o.behind FROM placed p JOIN subroots s ON s.name = p.tree JOIN outer_ o ON o.idx = s.idx),
proofs AS (
  SELECT tree, idx, sha256(string_agg(before || behind, '' ORDER BY level)) AS proof, list(before || '|' || behind ORDER BY level) AS steps FROM paths GROUP BY tree, idx),
folded AS (
  SELECT p.doc_id, p.hash AS leaf, s.hash AS subroot, (SELECT hash FROM high WHERE n = 1) AS root, coalesce(f.proof, sha256('')) AS proof_sha256,
         list_reduce(list_concat([p.claimed], coalesce(f.steps, [])), lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) AS folded_root
  FROM placed p JOIN subroots s ON s.name = p.tree LEFT JOIN proofs f ON f.tree = p.tree AND f.idx = p.idx)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_derivatives": OP1_SQL, "op3_ball_tree_topk": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_ngram_jaccard": OP6_SQL,
        "op11_turn_repair": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
    }
