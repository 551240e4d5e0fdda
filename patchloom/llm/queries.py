"""One query for each operator, over whole tables, and the SQL that makes the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import (
    chat_format,
    decontaminate,
    divergence,
    exact_dedup,
    html_text,
    jaccard_join,
    language_id,
    line_dedup,
    media_ts,
    mixing,
    substring_dedup,
    tokens,
    vector_codes,
)
from patchloom.llm.common import scratch_path, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_key_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.array_join("kept", "\n"), "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.dedup_spans(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_sentences", "n_removed", "n_words_removed", "text")


def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 removes, in numbers, which SQL can tell from all runs of 50 words."""
    return op2_substring_dedup(spark, sf_dir).select("doc_id", "n_sentences", "n_removed", "n_words_removed")


SUBSTRING_SQL = r"""
WITH pieces AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])([\x20\x09-\x0D])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS ps FROM documents),
sentences AS (
  SELECT doc_id, unnest(parts) AS ws, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(ps, lambda p: regexp_extract_all(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')), lambda ws: len(ws) > 0) AS parts FROM pieces)),
placed AS (
  SELECT doc_id, pos, ws, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY pos) - len(ws) AS a FROM sentences),
whole AS (SELECT doc_id, flatten(list(ws ORDER BY pos)) AS ws FROM placed GROUP BY 1),
runs AS (
  SELECT doc_id, i, hash(ws[i:i + 49]) AS h, hash('x', ws[i:i + 49]) AS h2 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM whole)),
firsts AS (SELECT h, h2, min(doc_id) AS d FROM runs GROUP BY 1, 2),
later AS (SELECT doc_id, i FROM runs JOIN firsts USING (h, h2) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, i + k - 1 AS w FROM later, range(0, 50) t(k)),
cut AS (
  SELECT p.doc_id, p.pos, count(g.w) AS n FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.w >= p.a AND g.w < p.a + len(p.ws) GROUP BY 1, 2)
SELECT d.doc_id, count(c.pos)::BIGINT AS n_sentences, (count(*) FILTER (n > 0))::BIGINT AS n_removed, coalesce(sum(n), 0)::BIGINT AS n_words_removed
FROM documents d LEFT JOIN cut c ON c.doc_id = d.doc_id GROUP BY 1
"""


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), path)
    return tokens.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s
  FROM words WHERE len(ws) > 0),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reached r JOIN both_ways l ON l.x = r.b)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = d.doc_id
"""


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = media_ts.read_back(media_ts.store(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.size("access_units").cast("long").alias("access_points"), "continuity_errors",
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.identify(documents, language_id.train(documents))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.trained(at_hand=html_text.sampled(pages)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that is no draw."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


TARGETS_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
weighed AS (SELECT *, ((r - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM sources),
ordered AS (
  SELECT *, cap / weight AS knee, coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights FROM weighed
  WINDOW w AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT knee, ((SELECT sum(source_size) FROM sources) - caps) / ((SELECT sum(weight) FROM weighed) - weights) AS level FROM ordered),
fill AS (SELECT arg_min(level, knee) AS level FROM levels WHERE level <= knee)
SELECT doc_id, size, source_size, round(least(cap, weight * coalesce(level, 0)), 3) AS target
FROM sized JOIN weighed ON weighed.source IS NOT DISTINCT FROM sized.source, fill
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "matched_words", F.size("tiles").cast("long").alias("n_tiles"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(more)))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g') AS out FROM turns),
whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(out) + 23)::BIGINT AS formatted_chars,
    (count(*) FILTER (out <> text))::BIGINT AS escaped_turns
  FROM escaped GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, escaped_turns FROM whole
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=3, ranks=200)


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
terms AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
groups AS (
  SELECT g.lang, g.source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sums USING (lang, source) LEFT JOIN sizes USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(n) + any_value(v)) AS q
  FROM counts JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term),
apart AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = r"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), "embedding")


def _lloyd_sql(rounds: int) -> str:
    """Assignments a0.. to codebooks e0.. of each part, round by round, as common table expressions."""
    out = [
        r"""WITH vectors AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, q[p * (len(q) // 4) + 1:(p + 1) * (len(q) // 4)] AS v FROM vectors, range(4) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM vectors ORDER BY vec_id LIMIT 256),
e0 AS MATERIALIZED (SELECT p, k, v AS c FROM parts JOIN firsts USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(struct_pack(d := d, k := k)) AS best FROM (
    SELECT vec_id, p, k, list_inner_product(list_transform(list_zip(v, c), lambda z: (z[1] - z[2])::DOUBLE), list_transform(list_zip(v, c), lambda z: (z[1] - z[2])::DOUBLE))::BIGINT AS d
    FROM parts JOIN e{r} USING (p)) GROUP BY vec_id, p)""")
        if r < rounds:
            out.append(f"""m{r} AS (
  SELECT p, k, list(m ORDER BY i) AS c FROM (
    SELECT p, best.k AS k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (
      SELECT vec_id, p, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts) JOIN a{r} USING (vec_id, p) GROUP BY p, best.k, i) GROUP BY p, k),
e{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{r}.c, e{r}.c) AS c FROM e{r} LEFT JOIN m{r} USING (p, k))""")
    out.append(f"""books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM e{rounds}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)""")
    return ",\n".join(out) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN vectors USING (vec_id), books"""


OP13_SQL = _lloyd_sql(4)

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_tokens": op3_tokens,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_media": op5_media,
    "op6_language_id": op6_language_id,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_vector_codes": op13_vector_codes,
    "substring_counts": substring_counts,
    "mixing_targets": mixing_targets,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
    "substring_counts": SUBSTRING_SQL,
    "mixing_targets": TARGETS_SQL,
}
