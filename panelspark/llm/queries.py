"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import chat, decontam, hostrules, lmscore, merkle, mixing, quality, secrets, simhash, spelling, substrings, toxicity, vectors
from panelspark.llm.common import ship, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    extra = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", "assistant"))])
    own = spark.range(1).select(F.explode(extra).alias("r")).select("r.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest_examples(chat.format_conversations(turns))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), lmscore.good_ids(table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_documents(table(spark, sf_dir, "documents"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_toxicity": op2_toxicity,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_secret_scans": op4_secret_scans,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_mixing": op6_mixing,
        "op7_simhash": op7_simhash,
        "op8_decontamination": op8_decontamination,
        "op9_vector_links": op9_vector_links,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_host_rules": op12_host_rules,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
    return {name: _shipping(query) for name, query in named.items()}


_CONTROL_SQL = r"""(?i)(<)(\||/?s>|</?SYS>>|(?:start|end)_of_turn>|(?:bos|eos|pad|unk)>)|(\[)(/?INST\])"""

OP3_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(replace(role, '\', '\\'), '{_CONTROL_SQL}', '\1\3\\\2\4', 'g')) +
         length(regexp_replace(replace(text, '\', '\\'), '{_CONTROL_SQL}', '\1\3\\\2\4', 'g')) + {len(chat.TURN + chat.TEXT + chat.END)} AS long
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(long) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(length(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant')), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


def _spans_sql(number: int, rule: secrets.Rule) -> str:
    """Spans of one rule: the running lengths of gaps and matches."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {number} AS kind, '{rule.kind}' AS name, i, value,
         (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit))::BIGINT AS s,
         sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e
  FROM (SELECT doc_id, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS vals,
                     string_split_regex(text, '{pattern}') AS gaps
              FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) WHERE len(hits) > 0)"""


OP4_SQL = f"""
WITH spans AS (
  SELECT * FROM ({" UNION ALL ".join(f"SELECT *, {r.least} AS least FROM ({_spans_sql(i, r)})" for i, r in enumerate(secrets.RULES))})
  WHERE length(value) >= least),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {secrets.BASE_KINDS}) AS base,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""

OP8_SQL = r"""
WITH item_lists AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
phrases AS (
  SELECT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS p
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item_lists WHERE len(ws) > 0)),
doc_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
grams AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS p
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM doc_lists, (SELECT DISTINCT k FROM phrases) WHERE len(ws) >= k)),
hits AS (SELECT DISTINCT g.doc_id, g.i, g.k, item_id FROM grams g JOIN phrases USING (k, p)),
words_hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_lists d LEFT JOIN words_hit h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
low AS (SELECT u, min(w) AS low FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.u LEFT JOIN low ON vec_id = low.u
"""

def _rate_sql(rule: str) -> str:
    """One rule's shrunk rate of a host."""
    noise = f"(k_{rule} / all_n * (1 - k_{rule} / all_n))"
    room = f"({noise} * (all_n - n_n / all_n - (m - 1)))"
    like = f"greatest(0, least(1, (kk_{rule} - k_{rule} * k_{rule} / all_n - {noise} * (m - 1)) / {room}))"
    return f"CASE WHEN {room} > 1e-9 THEN ({like} * {rule} + (1 - {like}) * k_{rule} / all_n) / ({like} * n + 1 - {like}) ELSE k_{rule} / all_n END"


OP12_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, regexp_extract_all(t, '{hostrules.NO_SPACE}+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{hostrules.NO_SPACE}+')) AS ls FROM split),
windows AS (
  SELECT r, i, array_to_string(ws[i : i + 2], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts WHERE len(ws) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
counted AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{hostrules.SPACE}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{hostrules.SYMBOL}', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM parts p LEFT JOIN covered c ON p.r = c.r),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER ({rule})::DOUBLE AS {name}" for name, rule in hostrules.RULES.items())} FROM counted GROUP BY source),
sums AS (
  SELECT count(*) AS m, sum(n) AS all_n, sum(n * n) AS n_n, {", ".join(f"sum({r}) AS k_{r}, sum({r} * {r} / n) AS kk_{r}" for r in hostrules.RULES)} FROM hosts),
rated AS (SELECT source, greatest({", ".join(map(_rate_sql, hostrules.RULES))}) AS rate FROM hosts, sums),
failing AS (SELECT *, {hostrules.RULES["base"]} AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= {hostrules.LIMIT} AS kept, round(rate, 9) AS host_rate
FROM failing f JOIN rated h ON f.source IS NOT DISTINCT FROM h.source
"""


def _crc32_sql(bytes_list: str) -> str:
    """CRC-32 of a list of bytes: eight shifts for each."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_list}), lambda c, b: {bits}), 4294967295)"


def _levels_sql(name: str, leaves: str, tree: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, idx, n, digest)."""
    return f"""{name} AS (
  SELECT {tree} AS tree, 0 AS level, idx, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 2, n)"""


def _leaf_sql(n_chars: str) -> str:
    fields = [n_chars if f == "n_chars" else f for f in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {spelling.MIN_LETTERS} GROUP BY doc_id, run),
sums AS (
  SELECT *, {_crc32_sql("flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda d: CASE WHEN ord(d) < 128 THEN [ord(d)::BIGINT] ELSE [195, ord(d)::BIGINT - 64] END))")} AS h FROM runs),
words AS (
  SELECT CASE WHEN h % {spelling.ALTERED} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, sum(times)::BIGINT AS n FROM sums GROUP BY 1),
known AS (SELECT * FROM words WHERE length(word) >= {spelling.MIN_LETTERS} AND n >= {spelling.MIN_COUNT}),
less AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM known)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN known b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN known b ON a.rest = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
forms AS (SELECT word, other AS form, other_n AS form_n FROM ranked WHERE place = 1 AND other_n >= {spelling.TIMES} * n),
ways AS (SELECT word, word AS last, 0 AS steps FROM known UNION ALL SELECT w.word, f.form, steps + 1 FROM ways w JOIN forms f ON f.word = w.last)
SELECT k.word, f.form, (SELECT arg_max(last, steps) FROM ways w WHERE w.word = k.word) AS root, k.n, coalesce(r.n_near, 0)::BIGINT AS n_near, f.form_n
FROM known k LEFT JOIN forms f ON f.word = k.word LEFT JOIN ranked r ON r.word = k.word AND r.place = 1
"""

OP13_SQL = f"""
WITH RECURSIVE digests AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS digest,
         CASE WHEN {_crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS other FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM digests),
{_levels_sql("nodes", "leaves", "tree")},
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_levels_sql("tops", "subroots", "''")},
steps AS (
  SELECT l.r, s.level AS k, l.idx >> s.level & 1 AS side, b.digest
  FROM leaves l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) s ON s.tree = l.tree
  LEFT JOIN nodes b ON b.tree = l.tree AND b.level = s.level AND b.idx = xor(l.idx >> s.level, 1)
  UNION ALL
  SELECT l.r, 1000 + s.level, t.idx >> s.level & 1, b.digest
  FROM leaves l JOIN subroots t ON t.tree = l.tree CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) s
  LEFT JOIN tops b ON b.level = s.level AND b.idx = xor(t.idx >> s.level, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS step FROM steps),
folds AS (
  SELECT r, 0::BIGINT AS step, coalesce(other, digest) AS digest FROM leaves
  UNION ALL
  SELECT f.r, s.step, sha256(CASE WHEN s.side = 1 THEN coalesce(s.digest, '') || f.digest ELSE f.digest || coalesce(s.digest, '') END)
  FROM folds f JOIN numbered s ON s.r = f.r AND s.step = f.step + 1),
ends AS (SELECT r, arg_max(digest, step) AS folded FROM folds GROUP BY r),
proofs AS (SELECT r, string_agg(digest, '' ORDER BY step) AS proof FROM numbered GROUP BY r)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       folded AS folded_root, folded = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN subroots t ON t.tree = l.tree JOIN ends e ON e.r = l.r LEFT JOIN proofs p ON p.r = l.r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": OP3_SQL,
        "op4_secret_scans": OP4_SQL,
        "op8_decontamination": OP8_SQL,
        "op9_vector_links": OP9_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_host_rules": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
