"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import table


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.token_transducer import op1_token_counts as op

    return op(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.chat_template import op2_chat_format as op

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    return op(rows.unionByName(spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.best_fit import op3_best_fit as op

    return op(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.token_shards import op4_token_shards as op

    return op(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.stream_dedup import op5_exact_dedup as op

    return op(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.jaccard_join import op6_jaccard_join as op

    return op(table(spark, sf_dir, "documents"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.piece_sampling import op7_piece_sampling as op

    return op(table(spark, sf_dir, "documents"), public("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.quality_gam import op8_quality as op

    return op(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.webp import op9_webp as op

    return op(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.personal_data import op10_personal_data as op

    return op(table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.block_max import op11_search as op

    return op(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.warc_zstd import op12_warc as op

    return op(table(spark, sf_dir, "pages"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.resampling import op13_resample as op

    return op(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_best_fit": op3_best_fit,
    "op4_token_shards": op4_token_shards,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_quality": op8_quality,
    "op9_webp": op9_webp,
    "op10_personal_data": op10_personal_data,
    "op11_search": op11_search,
    "op12_warc": op12_warc,
    "op13_resample": op13_resample,
}

OP2_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '[\\<\[\]]', '..', 'g')) + length(regexp_replace(t, '[\\<\[\]]', '..', 'g')) + length('<s>[INST:] [/INST]</s>') AS n FROM r),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) AS whole, coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM a
"""
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM r JOIN l ON x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
OP11_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
p AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
f AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // total AS m FROM l, c),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
OP12_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), k AS (SELECT page_id, b, octet_length(b) AS n, max(page_id) OVER (PARTITION BY b) AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM k
"""
#: The CRC-32 of a feature runs over its bytes by a table that is made from the polynomial.
OP13_SQL = r"""
WITH RECURSIVE z(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM z WHERE k = 8),
x AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT kind, id, unnest(w) AS f FROM w UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1),
n AS (SELECT kind, id, f, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT DISTINCT f FROM n),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, crc),
b AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::BIGINT AS t FROM n JOIN h USING (f) GROUP BY bucket),
a AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM b),
g AS (SELECT bucket, floor(1000 * ln((b.t + 1) * (a.s + 10000) / ((b.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM b, a),
v AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN h USING (f) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY id),
e AS (SELECT d.id AS doc_id, len(d.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || d.id), 1, 8))::BIGINT AS h FROM w d LEFT JOIN v ON v.doc_id = d.id WHERE kind = 'd'),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM o WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM o LEFT JOIN r USING (doc_id)
"""
ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op11_search": OP11_SQL, "op12_warc": OP12_SQL, "op13_resample": OP13_SQL}
