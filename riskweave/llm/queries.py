"""The registered queries of the training-data operators: thin forms with production parameters
over whole tables. ``ORACLE`` holds the DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import common as c

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_ngram_jaccard_join")
def op1(spark, sf):
    from riskweave.llm.ngram_join import jaccard_components
    return jaccard_components(c.documents(spark, sf))


@query("op9_best_fit_packing")
def op9(spark, sf):
    from riskweave.llm.packing import best_fit_packing
    return best_fit_packing(c.documents(spark, sf))


@query("op10_sharding")
def op10(spark, sf):
    from pyspark.sql import functions as F

    from riskweave.llm.sharding import read_shards, write_shards
    docs, path = c.documents(spark, sf), f"{c.stage_root(spark)}/shards"
    write_shards(docs, path)
    text = F.coalesce("record.text", F.lit(""))
    return read_shards(docs, path).select(
        "record.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_warc")
def op5(spark, sf):
    from riskweave.llm.warc import archive_pages, page_digest
    return page_digest(archive_pages(c.documents(spark, sf, "pages"), c.stage_root(spark)))


@query("op7_token_counts")
def op7(spark, sf):
    import public_tokenizers

    from riskweave.llm.bpe_count import token_counts
    return token_counts(c.documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_suffix_array_dedup")
def op3(spark, sf):
    from riskweave.llm.suffix_dedup import remove_repeats
    return remove_repeats(c.documents(spark, sf), kept=None)


@query("op8_substring_dedup")
def op8(spark, sf):
    from pyspark.sql import functions as F

    from riskweave.llm.cdc import dedup_chunks
    return dedup_chunks(c.documents(spark, sf)).select(
        "doc_id", "n_bytes", "n_shared", "shared_bytes", "n_cut", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_language_id")
def op6(spark, sf):
    from riskweave.llm import langid
    docs = c.documents(spark, sf)
    model = langid.fit_documents(docs)
    return langid.predict(docs.select("doc_id", "text"), model, columns=["doc_id"]).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op4_fertility_rules")
def op4(spark, sf):
    import public_tokenizers

    from riskweave.llm.fertility import judge
    return judge(c.documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"), columns=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "tokens_per_word", "byte_share", "entropy")


@query("op2_benchmark_decontamination")
def op2(spark, sf):
    from riskweave.llm.decontam import contaminated
    return contaminated(c.documents(spark, sf), c.documents(spark, sf, "benchmark"))


@query("op11_importance_resampling")
def op11(spark, sf):
    from riskweave.llm.resample import resample
    return resample(c.documents(spark, sf), c.documents(spark, sf, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank", "n_words")


@query("op12_embedding_near_dedup")
def op12(spark, sf):
    from riskweave.llm.vector_graph import near_duplicates
    return near_duplicates(c.documents(spark, sf, "embeddings"))


@query("op13_phrase_collocations")
def op13(spark, sf):
    from riskweave.llm.collocations import collocations
    return collocations(c.documents(spark, sf))


# ---------------------------------------------------------------- DuckDB SQL of the results that SQL can express

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE["op1_ngram_jaccard_join"] = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
x AS (SELECT doc_id, unnest(s) AS sh FROM sets),
links AS (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM x p JOIN x q ON p.sh = q.sh AND p.doc_id <> q.doc_id GROUP BY 1, 2) c
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 85 * (na.n_shingles + nb.n_shingles - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n_shingles, m.component_id
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON n.doc_id = m.a"""

ORACLE["op3_suffix_array_dedup"] = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 199)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) r ON w.k = r.k),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 200 AS e
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
parts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS after FROM runs),
kept AS (
  SELECT d.doc_id, any_value(hx) AS hx, count(s) AS n_spans, coalesce(sum(e - s), 0) AS n_removed,
         coalesce(string_agg(substr(hx, 2 * after + 1, 2 * (s - after)), '' ORDER BY s), '') || substr(any_value(hx), 2 * coalesce(max(e), 0) + 1) AS rest
  FROM d LEFT JOIN parts ON d.doc_id = parts.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(rest)) AS kept_sha256 FROM kept"""

_digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * k}) & 31 AS INTEGER) + 1, 1)"
                      for g in range(4) for k in range(8))
ORACLE["op5_warc"] = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_digits} AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to FROM f"""


def _crc_table() -> list[int]:
    """The 256 remainders of the reflected polynomial 0xEDB88320 (crc32)."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _features(table: str, id_col: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""SELECT {id_col} AS id, ws, list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS fs
  FROM (SELECT {id_col}, {words} AS ws FROM {table})"""


ORACLE["op11_importance_resampling"] = f"""WITH d AS ({_features('documents', 'doc_id')}),
b AS ({_features('benchmark', 'item_id')}),
df AS (SELECT id, unnest(fs) AS f FROM d),
bf AS (SELECT unnest(fs) AS f FROM b),
hx AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
crc AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                            lambda h, v: xor(h >> 8, t[(xor(h, v) & 255) + 1])), 4294967295::BIGINT) % 10000 AS k
  FROM hx, (SELECT {_crc_table()}::BIGINT[] AS t)),
dk AS (SELECT k, count(*) AS s FROM df JOIN crc USING (f) GROUP BY k),
bk AS (SELECT k, count(*) AS t FROM bf JOIN crc USING (f) GROUP BY k),
g AS (
  SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM dk) + 10000))::DOUBLE
                            / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM bk), 0) + 10000))::DOUBLE))::BIGINT AS gain
  FROM dk LEFT JOIN bk USING (k)),
w AS (SELECT id, sum(gain) AS total FROM df JOIN crc USING (f) JOIN g USING (k) GROUP BY id),
scored AS (
  SELECT d.id, len(ws) AS n_words, len(fs) AS n, CASE WHEN len(fs) = 0 THEN 0 ELSE floor(total / len(fs))::BIGINT END AS weight,
         ('0x' || substr(sha256('7:' || coalesce(d.id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN w ON d.id = w.id),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, count(*) OVER () AS able FROM s WHERE n_words >= 20)
SELECT s.id AS doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank, n_words::BIGINT AS n_words
FROM s LEFT JOIN r ON s.id = r.id"""

ORACLE["op12_embedding_near_dedup"] = """WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT a AS vec_id, (SELECT count(*) FROM links WHERE links.a = m.a) AS n_links, component_id, a = component_id AS kept FROM m"""

ORACLE["op13_phrase_collocations"] = f"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM ws, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.g, c.m, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.m = k AND l.g = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.m = c.m - k AND r.g = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + len - 1], ' ') AS g, max(a) AS around
  FROM (SELECT *, unnest(range(1, m - len + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS len FROM cand)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.g = b.g WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT ranked.lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""
