"""The registered queries of this subpackage: thin calls of the operators on whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialedger.llm import chat, decontamination, fm_classifier, hard_negatives, html_mincut, merkle, packing, pseudonyms, quality_rules, sharding, substring_dedup
from medialedger.llm.jaccard_join import JaccardJoin
from medialedger.llm.multi_index import MultiIndex
from medialedger.llm.store import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered queries; a deployment passes its own.
PSEUDONYM_KEY = "medialedger"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op2_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shuffled_shards(docs, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", shards=8)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_mincut.extract(pages, html_mincut.train(pages))


def op5_fm_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fm_classifier.score(docs, fm_classifier.train(docs, table(spark, sf_dir, "labels")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer, end_id=1, capacity=4096)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, "assistant", ok)], rows.schema)
    examples = chat.expand(rows.unionByName(probe))
    loss = F.struct("example", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text"))
    read = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(loss)), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    read = read.withColumn("turns", chat.read_turns(F.col("whole")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(F.array_join(F.transform("turns", line), "")).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars",
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(shingle=5, numerator=80).components(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(tampered, merkle.row_digest(*row[:-1], F.replace("text", F.lit("\n"), F.lit(""))))
    out = merkle.manifest(table(spark, sf_dir, "documents"), F.col("source"), "doc_id", merkle.row_digest(*row), found)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"), "folded_root", "verified")


def op13_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MultiIndex(threshold=0.98).classes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_two_pass_shuffle": op2_two_pass_shuffle,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_mincut": op4_html_mincut,
    "op5_fm_classifier": op5_fm_classifier,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_multi_index_dedup": op13_multi_index_dedup,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ESCAPED = "coalesce({0}, '')"
_ESCAPED = f"replace({_ESCAPED}, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

_RATES = (
    "n_symbols / greatest(n_words, 1)", "n_marks / greatest(n_words, 1)", "n_upper / greatest(word_chars, 1)", "n_repeat_words / greatest(n_words, 1)",
    "n_dup_lines / greatest(n_lines, 1)", "word_chars / greatest(n_words, 1)",
)
#: A rule's level is the number of its cutoffs (from lax to strict) that a text's rate does not exceed.
_LEVEL = "least(" + ", ".join(
    f"len([c FOR c IN {cutoffs} IF CAST({rate} AS DOUBLE) <= c])" for rate, cutoffs in zip(_RATES, quality_rules.RULES.values(), strict=True)
) + ")"
_LINES = r"[x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')]"
_COUNT = "CAST(length(t) - length(regexp_replace(t, '{}', '', 'g')) AS BIGINT)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_FIELDS = ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_WHOLE = "vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
#: CRC-32 of the decimal doc_id, bit by bit: a character is mixed in, then eight steps follow.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
)

ORACLES: dict[str, str] = {
    "op3_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {_COUNT.format("[#*$%&|<>]")} AS n_symbols,
  CAST(len({_LINES}) - len(list_distinct({_LINES})) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, {_COUNT.format("[A-Z]")} AS n_upper,
  {_COUNT.format(r"[!?@^_~=+/{}\[\]\\]")} AS n_marks, CAST(len({_LINES}) AS BIGINT) AS n_lines FROM d LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST({_LEVEL} AS BIGINT) AS level FROM c),
marks AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
held AS (SELECT f.doc_id, lang, q, min(level) AS level FROM f JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY f.doc_id, lang, q),
j AS (SELECT unnest(range(0, {quality_rules.LEVELS})) AS j),
seen AS (SELECT lang, j, count(*) FILTER (WHERE q = 1) AS n, count(*) FILTER (WHERE q = 1 AND level <= j) AS good, count(*) FILTER (WHERE q = 0 AND level <= j) AS bad FROM held, j GROUP BY lang, j),
cdf AS (SELECT lang, j, n, bad, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05::DOUBLE) + (n - i) * ln(0.95::DOUBLE)) FOR i IN range(0, good + 1)]) AS p FROM seen WHERE n > 0),
ok AS (SELECT lang, j, bad, bool_and(p <= 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang FROM held))) OVER (PARTITION BY lang ORDER BY j) AS certified FROM cdf),
cut AS (SELECT lang, first(j ORDER BY bad DESC, j) AS j FROM ok WHERE certified AND bad > 0 GROUP BY lang)
SELECT f.doc_id, f.lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_lines, base_failed, level, coalesce(cut.j, -1) AS cutoff_level,
  NOT base_failed AND level > coalesce(cut.j, -1) AS kept FROM f LEFT JOIN cut ON cut.lang IS NOT DISTINCT FROM f.lang""",
    "op8_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  {len(chat.START + chat.TEXT + chat.END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS shown FROM c),
w AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY turn) AS run, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(run) FILTER (WHERE role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id""",
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
best AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(best.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN best USING (doc_id)""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE g IN (SELECT g FROM rep))),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE concat('s', source) END AS tree,
  sha256(concat({_FIELDS}, {_FIELD.format("text")})) AS leaf, {_CRC} % 2 = 0 AS tampered, sha256(concat({_FIELDS}, {_FIELD.format("replace(text, chr(10), '')")})) AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS rank FROM d),
node AS (SELECT tree, 0 AS level, rank AS i, leaf AS h FROM leaves UNION ALL
  SELECT tree, any_value(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE tree IN (SELECT tree FROM node WHERE i > 0) GROUP BY tree, i // 3),
sub AS (SELECT tree, arg_max(h, level) AS subroot, max(level) AS height FROM node GROUP BY tree),
places AS (SELECT tree, subroot, height, row_number() OVER (ORDER BY CAST(tree AS BLOB)) - 1 AS i FROM sub),
top AS (SELECT 0 AS level, i, subroot AS h FROM places UNION ALL
  SELECT any_value(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE (SELECT max(i) FROM top) > 0 GROUP BY i // 3),
every AS (SELECT tree, level, i, h FROM node UNION ALL SELECT NULL, level, i, h FROM top),
steps AS (SELECT rid, l.tree AS tree, level, level AS own, rank // CAST(pow(3, level) AS BIGINT) AS i FROM leaves l JOIN places p USING (tree), range(0, 99) AS x(level) WHERE level < p.height
  UNION ALL SELECT rid, NULL, p.height + x.level, x.level, p.i // CAST(pow(3, x.level) AS BIGINT) FROM leaves l JOIN places p USING (tree), range(0, 99) AS x(level) WHERE x.level < (SELECT max(level) FROM top)),
sib AS (SELECT s.rid, s.level, coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (WHERE e.i < s.i), '') AS before, coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (WHERE e.i > s.i), '') AS after
  FROM steps s JOIN every e ON e.tree IS NOT DISTINCT FROM s.tree AND e.level = s.own AND e.i // 3 = s.i // 3 GROUP BY s.rid, s.level),
folded AS (SELECT rid, 0 AS level, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM leaves UNION ALL
  SELECT f.rid, f.level + 1, sha256(concat(before, f.h, after)) FROM folded f JOIN sib s ON s.rid = f.rid AND s.level = f.level),
last AS (SELECT rid, arg_max(h, level) AS folded_root FROM folded GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(concat(before, after), '' ORDER BY level)) AS proof FROM sib GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT arg_max(h, level) FROM top) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT arg_max(h, level) FROM top) AS verified
FROM leaves JOIN places USING (tree) JOIN last USING (rid) LEFT JOIN proofs USING (rid)""",
    "op11_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE {_WHOLE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 3""",
    "op13_multi_index_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {_WHOLE} AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)""",
}
