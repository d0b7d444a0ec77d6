"""The operators of this package as registered queries, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubal.llm import chat, embedding_dedup, exact_dedup, html_extract, langid, licenses, merkle, mixing, packing, periodic_runs, quality, simhash, substring_dedup
from tubal.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _crc():
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def _remainder(n: int):
    return F.pmod(_crc(), F.lit(n))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("loss_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string")))
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations")).withColumn("loss_spans", F.array_join(spans, ","))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = langid.training_sample(docs.where(_remainder(5) != 0))
    found = langid.identify(docs, training)
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = quality.training_sample(docs, table(spark, sf_dir, "labels").where(_remainder(3) != 1))
    scored = quality.score_quality(docs.select("doc_id", "text"), training).select("row.doc_id", "score")
    return scored.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.floor(_crc() / 10)
    tail = F.when(_crc() % 10 == 0, F.struct(g.alias("shift"), (3 + g % 8).alias("spread")))
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), tail, keep=["doc_id"])
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), *best, "runs_sha256", "collapsed_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf, tampered = (merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text) for text in (F.col("text"), lowered))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", leaf.alias("leaf"), F.when(_crc() % 5 == 0, tampered).alias("claimed"))
    found = merkle.manifest(rows).withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_embedding_near_dedup, op3_chat_rotation, op4_packing, op5_language_id, op6_substring_dedup,
    op7_exact_dedup, op8_source_mixing, op9_quality_classifier, op10_simhash_near_dedup,
    op11_periodic_runs, op12_merkle_manifest, op13_license_scan,
)}

_CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN role <> '' THEN replace(replace(role, '<|', '<||'), '|>', '||>') END AS speaker,
         replace(replace(coalesce(text, ''), '<|', '<||'), '|>', '||>') || '<|end|>' || chr(10) AS body
  FROM conversations),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body) - 1) // {chat.PART_TURNS} AS part FROM turns),
rendered AS (
  SELECT t.*, p.perspective, t.speaker IS NOT DISTINCT FROM p.perspective AS own,
         CASE WHEN t.speaker IS NOT DISTINCT FROM p.perspective THEN '<|assistant|>' WHEN t.speaker = 'system' THEN '<|system|>'
              ELSE '<|user' || coalesce(' name=' || t.speaker, '') || '|>' END || chr(10) AS head
  FROM numbered AS t JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker IS DISTINCT FROM 'system') AS p
    ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part
            ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body ROWS UNBOUNDED PRECEDING) - length(body) AS body_from
  FROM rendered)
SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body) AS text,
       coalesce(string_agg(CAST(body_from AS VARCHAR) || ':' || CAST(length(body) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body) FILTER (WHERE own), '') AS loss_spans
FROM placed GROUP BY conv_id, perspective, part
"""

_EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same_text AS keep_id, count(*) OVER same_text AS group_size,
       doc_id = max(doc_id) OVER same_text AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same_text AS (PARTITION BY coalesce(text, ''))
"""


def _permuted_sql(index: str, n: str, key: str, rounds: int, source: str) -> str:
    """CTEs p0..p{rounds} over the rows of ``source``; the last has the column ``idx``."""
    seven = lambda text: f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"
    out = [f"p0 AS (SELECT *, {index} AS idx, {n} AS n, {key} AS k FROM {source})"]
    for r in range(1, rounds + 1):
        offset = f"({seven(f"'k/' || k || '/{r}'")} * 268435456 + {seven(f"'l/' || k || '/{r}'")})"
        other = f"((({offset} - idx) % n + n) % n)"
        out.append(f"q{r} AS (SELECT *, {other} AS other FROM p{r - 1})")
        out.append(f"p{r} AS (SELECT * EXCLUDE (idx, other), CASE WHEN substr(md5(k || '/{r}/' || CAST(greatest(idx, other) AS VARCHAR)), 1, 1) < '8' THEN idx ELSE other END AS idx FROM q{r})")
    return ", ".join(out)


_MIX_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighted AS (SELECT *, CAST([3, 1, 2][nth % 3 + 1] AS BIGINT) AS weight, 2 * source_size AS lim FROM per),
ranked AS (
  SELECT *, coalesce(sum(lim) OVER before, 0) AS limits_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights_left,
         sum(source_size) OVER () * 1.5 AS total
  FROM weighted WINDOW before AS (ORDER BY lim / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, (CAST(total AS DOUBLE) - CAST(limits_before AS DOUBLE)) / CAST(weights_left AS DOUBLE) AS level FROM ranked),
found AS (SELECT *, (SELECT level FROM levelled WHERE level * weight < lim ORDER BY lim / weight, level DESC LIMIT 1) AS common FROM levelled),
targets AS (
  SELECT nth, source, source_size, CASE WHEN common IS NULL THEN CAST(lim AS DOUBLE) ELSE least(CAST(lim AS DOUBLE), weight * common) END AS target,
         CAST(ceil(source_size / {mixing.BLOCK_WORDS}.0) AS BIGINT) AS blocks FROM found),
worded AS (SELECT *, least(CAST(round_even(target, 0) AS BIGINT), 2 * source_size) AS words FROM targets),
needing AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2 * blocks, words // source_size * blocks
     + CAST(ceil((words % source_size) / {mixing.BLOCK_WORDS}.0) AS BIGINT) + CASE WHEN words % source_size > 0 THEN 1 ELSE 0 END) END AS slots FROM worded),
numbered AS (SELECT nth, blocks, source_size, words, unnest(range(slots)) AS ordinal FROM needing),
{_permuted_sql("ordinal % blocks", "blocks", "'mix/' || nth || '/' || (ordinal // blocks)", mixing.ROUNDS, "numbered")},
taking AS (
  SELECT nth, ordinal, idx AS block, greatest(0, least({mixing.BLOCK_WORDS}, words - (ordinal * {mixing.BLOCK_WORDS} - (blocks * {mixing.BLOCK_WORDS} - source_size)
     * coalesce(sum(CASE WHEN idx = blocks - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY nth ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))) AS block_most
  FROM p{mixing.ROUNDS}),
firsts AS (SELECT nth, slots, coalesce(sum(slots) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_slot FROM needing),
drawn AS (
  SELECT place // {mixing.SHARD_SLOTS} AS shard, CAST('0x' || substr(md5('mix/draw/' || place), 1, 14) AS BIGINT) % (SELECT greatest(sum(slots), 1) FROM needing) AS draw
  FROM range((SELECT CAST(sum(slots) AS BIGINT) FROM needing)) AS g(place)),
counts AS (SELECT shard, nth, count(*) AS n FROM drawn JOIN firsts ON draw >= first_slot AND draw < first_slot + slots GROUP BY ALL),
indexed AS (SELECT shard, nth, slots, unnest(range(CAST(a AS BIGINT), CAST(a + n AS BIGINT))) AS ordinal
  FROM (SELECT shard, nth, n, sum(n) OVER (PARTITION BY nth ORDER BY shard ROWS UNBOUNDED PRECEDING) - n AS a FROM counts) AS c JOIN firsts USING (nth)),
spare AS (SELECT shard, row_number() OVER (ORDER BY nth, ordinal) AS number FROM indexed WHERE ordinal >= slots),
free AS (SELECT nth, ordinal, row_number() OVER (ORDER BY nth, ordinal) AS number FROM numbered ANTI JOIN indexed USING (nth, ordinal)),
dealt AS (SELECT shard, nth, ordinal FROM indexed WHERE ordinal < slots UNION ALL SELECT shard, nth, ordinal FROM spare JOIN free USING (number)),
places AS (SELECT nth, ordinal, shard, shard * {mixing.SHARD_SLOTS} + row_number() OVER (PARTITION BY shard ORDER BY md5('mix/place/' || nth || '/' || ordinal), nth, ordinal) - 1 AS place FROM dealt),
located AS (SELECT nth, taking.block, taking.block_most, place, shard FROM taking JOIN places USING (nth, ordinal)),
placed AS (
  SELECT doc_id, size, nth, sum(size) OVER (PARTITION BY nth ORDER BY md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS frm
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
pieces AS (
  SELECT doc_id, size, nth, frm, unnest(range(CAST(frm // {mixing.BLOCK_WORDS} AS BIGINT), CAST((frm + size - 1) // {mixing.BLOCK_WORDS} AS BIGINT) + 1)) AS block
  FROM placed WHERE size > 0),
shares AS (
  SELECT doc_id, nth, place, shard, least(least(frm + size, (block + 1) * {mixing.BLOCK_WORDS}) - greatest(frm, block * {mixing.BLOCK_WORDS}),
         block_most - (greatest(frm, block * {mixing.BLOCK_WORDS}) - block * {mixing.BLOCK_WORDS})) AS taken
  FROM pieces JOIN located USING (nth, block)),
taken AS (SELECT doc_id, nth, sum(taken) AS taken, count(*) AS n_pieces, min(shard) AS first_shard, min(place) AS first_place FROM shares WHERE taken > 0 GROUP BY doc_id, nth)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken, CAST(coalesce(k.n_pieces, 0) AS BIGINT) AS n_pieces, k.first_shard, k.first_place
FROM sized AS s JOIN targets AS t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken AS k ON k.doc_id = s.doc_id AND k.nth = t.nth
"""

_EMBEDDING_SQL = f"""
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {embedding_dedup.THRESHOLD}),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links AS l WHERE l.a = e.vec_id) AS n_links, r.component_id, e.vec_id IS NOT DISTINCT FROM r.component_id AS kept
FROM embeddings AS e LEFT JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) AS r ON r.a = e.vec_id
"""

_REPEATS_SQL = f"""
WITH worded AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT nth, w, unnest(range(1, len(w) - {substring_dedup.WINDOW} + 2)) AS i FROM worded WHERE len(w) >= {substring_dedup.WINDOW}),
hashed AS (SELECT nth, i, md5(array_to_string(w[i:i + {substring_dedup.WINDOW} - 1], ' ')) AS h FROM windows),
repeated AS (SELECT nth, i FROM hashed QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT nth, unnest(range(i, i + {substring_dedup.WINDOW})) AS i FROM repeated),
words AS (SELECT nth, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM worded),
kept AS (SELECT nth, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS joined FROM words ANTI JOIN gone USING (nth, i) GROUP BY nth)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (nth)
"""


def _trees_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs over ``leaves`` (tree, nth, node, n): ``{name}{k}``, their nodes k levels up, ``{name}_runs{k}``, the runs of
    nodes that have a parent, and ``{name}_tops``. With ``levels`` levels a tree may have 16 ** levels leaves."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        out.append(f"{name}_runs{k} AS (SELECT tree, nth // 16 AS run, list(node ORDER BY nth) AS nodes, max(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT tree, run AS nth, sha256(array_to_string(nodes, '')) AS node, (n + 15) // 16 AS n FROM {name}_runs{k})")
    tops = " UNION ALL ".join(f"SELECT tree, node FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*out, f"{name}_tops AS ({tops})"])


def _folds_sql(name: str, trees: str, start: str, levels: int) -> str:
    """CTEs ``{name}0`` to ``{name}{levels}`` that take the rows of ``start`` (tree, nth, node, proof) up their trees."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        before, after = (f"array_to_string(r.nodes[{cut}], '')" for cut in ("1:p.nth % 16", "p.nth % 16 + 2:"))
        out.append(
            f"{name}{k + 1} AS (SELECT p.* EXCLUDE (nth, node, proof), p.nth // 16 AS nth, CASE WHEN r.run IS NULL THEN p.node ELSE sha256({before} || p.node || {after}) END AS node, "
            f"p.proof || CASE WHEN r.run IS NULL THEN '' ELSE {before} || {after} END AS proof FROM {name}{k} AS p LEFT JOIN {trees}_runs{k} AS r ON p.tree = r.tree AND p.nth // 16 = r.run)"
        )
    return ", ".join(out)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    byte = "xor(crc, ascii(c))"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda b: xor(b >> 1, (b & 1) * 3988292384))[1]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, c: {byte.replace('ascii(c)', 'c')}), 4294967295)"


_FIELDS = [_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars")]
_MERKLE_SQL = f"""
WITH hashed AS (
  SELECT doc_id, source, sha256({" || ".join(_FIELDS)} || {_field_sql("text")}) AS leaf,
         sha256({" || ".join(_FIELDS)} || {_field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered,
         coalesce({_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0, false) AS tampers
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
{_trees_sql("t", "SELECT tree, nth, leaf AS node, n FROM placed", 5)},
{_trees_sql("s", "SELECT 0 AS tree, tree AS nth, node, count(*) OVER () AS n FROM t_tops", 4)},
{_folds_sql("f", "t", "SELECT doc_id, tree, tree AS source_nth, nth, leaf, CASE WHEN tampers THEN lowered ELSE leaf END AS node, '' AS proof FROM placed", 5)},
{_folds_sql("g", "s", "SELECT doc_id, source_nth, leaf, 0 AS tree, source_nth AS nth, node, proof FROM f5", 4)}
SELECT g4.doc_id, g4.leaf, t_tops.node AS subroot, s_tops.node AS root, sha256(g4.proof) AS proof_sha256, g4.node AS folded_root, g4.node = s_tops.node AS verified
FROM g4 JOIN t_tops ON t_tops.tree = g4.source_nth CROSS JOIN s_tops
"""


def _places_sql() -> str:
    rows = []
    for i, (base, (label, text)) in enumerate([*((True, x) for x in licenses.PHRASES), *((False, x) for x in licenses.NOTICES)]):
        words = text.split(" ")
        grams = [" ".join(words[k : k + licenses.GRAM]) for k in range(len(words) - licenses.GRAM + 1)]
        rows += [f"({i}, '{label}', {base}, {len(grams)}, {at}, '{gram}')" for at, gram in enumerate(grams)]
    return ", ".join(rows)


_LICENSE_SQL = f"""
WITH places(template, label, base, length, place, gram) AS (VALUES {_places_sql()}),
worded AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (SELECT nth, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT nth, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) > 2)),
voted AS (SELECT nth, template, label, base, length, pos - place AS diagonal, min(pos) AS frm, max(pos) AS upto, list(place) AS held FROM grams JOIN places USING (gram) GROUP BY ALL),
apart AS (SELECT *, base OR diagonal - coalesce(lag(diagonal) OVER (PARTITION BY nth, template ORDER BY diagonal), -(1 << 30)) > {licenses.NEAR} AS new FROM voted),
numbered AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY nth, template ORDER BY diagonal) AS span FROM apart),
spans AS (SELECT nth, template, label, base, length, span, min(diagonal) AS start, min(frm) AS frm, max(upto) AS upto, len(list_distinct(flatten(list(held)))) / length AS share FROM numbered GROUP BY nth, template, label, base, length, span),
fitting AS (SELECT * FROM spans WHERE CASE WHEN base THEN share = 1 ELSE share >= {licenses.COVERED} AND upto - frm + 1 <= length * {licenses.LONGEST} END),
found AS (
  SELECT nth, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM fitting GROUP BY nth)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM worded LEFT JOIN found USING (nth)
"""

ORACLE_SQL = {"op12_merkle_manifest": _MERKLE_SQL, "op13_license_scan": _LICENSE_SQL, "op2_embedding_near_dedup": _EMBEDDING_SQL, "op6_substring_dedup": _REPEATS_SQL, "op3_chat_rotation": _CHAT_SQL, "op7_exact_dedup": _EXACT_SQL, "op8_source_mixing": _MIX_SQL}
