"""Registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (ann, chat, iblt, lang_id, lexical, merkle, minhash, mix_model, mixing, packing, quality,
                       secret_scan, token_count)
from quire.llm.common import remainder
from quire.session import materialize
from quire.sources.tables import table


def tokenizer_files() -> dict:
    """Ranks and split pattern of the byte-level BPE (the ids of byte_bpe_50k.json)."""
    import public_tokenizers as P
    return {"ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_context_mixing(spark, sf_dir):
    return mix_model.score(_documents(spark, sf_dir))


#: The conversation that the formatting query adds: texts that are control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in PROBE) + " AS t(conv_id, turn, role, text)")
    return chat.digest(materialize(chat.formatted(conv.unionByName(probe)), "formatted"))


def op3_secret_scan(spark, sf_dir):
    return secret_scan.report(_documents(spark, sf_dir).select("doc_id", "text"))


def language_model(docs: DataFrame) -> lang_id.Model:
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2."""
    return lang_id.train(docs.where(remainder("doc_id", 4) != 2).select("text", "lang"))


def op4_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    out = lang_id.detect(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_mix_sources(spark, sf_dir):
    plan = mixing.planned(_documents(spark, sf_dir))
    return plan.select(F.col("mx_id").alias("doc_id"), F.col("mx_n").alias("size"), F.col("mx_size").alias("source_size"),
                       F.col("mx_target").alias("target"), (F.col("mx_n") * F.col("mx_copies")).alias("taken"))


def op6_one_bit_codes(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), query=F.col("id") % 50 == 0, k=5)


def op7_token_count(spark, sf_dir):
    import public_tokenizers as P
    return token_count.counts(_documents(spark, sf_dir), P.path("piece_bpe_32k.model"))


def op8_packing(spark, sf_dir):
    out = packing.pack(_documents(spark, sf_dir), **tokenizer_files())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_bloom_lookup(spark, sf_dir):
    return iblt.fingerprints(_documents(spark, sf_dir)).drop(*iblt.RECOVERED)


def op10_minhash_dedup(spark, sf_dir):
    return minhash.groups(_documents(spark, sf_dir), k=4)


def op11_merkle_manifest(spark, sf_dir):
    """Every seventh document (by crc32 of its id) claims one character more."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    tree = merkle.manifest(_documents(spark, sf_dir), changed={"n_chars": more}, where=remainder("doc_id", 7) == 0)
    root = F.lit(tree.root).cast("string")

    def text(c):
        return F.lower(F.hex(c))

    return merkle.proofs(tree).select(
        F.col("key").alias("doc_id"), text("digest").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))


def op12_lexical_search(spark, sf_dir):
    return lexical.search(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark, sf_dir):
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2."""
    feats = quality.features(_documents(spark, sf_dir), learn=remainder("doc_id", 4) != 2)
    out = quality.score(feats, quality.train(feats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_one_bit_codes": op6_one_bit_codes,
    "op7_token_count": op7_token_count,
    "op8_packing": op8_packing,
    "op9_bloom_lookup": op9_bloom_lookup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality_classifier": op13_quality_classifier,
}


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def _escaped(c: str) -> str:
    for plain, put in chat.ESCAPES:
        c = f"replace({c}, '{plain}', '{put}')"
    return c


_UNIT = "(('0x' || substr(md5({}), 1, 12))::BIGINT::DOUBLE / 281474976710656.0)"
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: crc32 of a text of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


#: Only where SQL can express the whole result.
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped('text')}) + CASE WHEN opens = 1 THEN 14 + 2 * length({_escaped('role')}) ELSE 5 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
    # targets: the level at which each source is cut, by closed form over the order of fill
    "op5_mix_sources": f"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, ceil(count(*) / 4096.0) AS strata,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
      FROM d GROUP BY source),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS every FROM s),
l AS (SELECT *, (every - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT *, (SELECT min_by(level, cap / w) FROM l x WHERE x.level * x.w < x.cap) AS final FROM l),
t AS (SELECT source, source_size, strata, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM g),
h AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             {_UNIT.format("'mix|' || doc_id")} AS h, strata FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(h * strata)::BIGINT AS stratum FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size, h, doc_id) AS k,
             rate - floor(rate) AS f, {_UNIT.format("'mix|stratum|' || coalesce(source, chr(0)) || '|' || stratum")} AS u FROM k)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (size * (floor(rate) + floor(k * f + u) - floor((k - 1) * f + u)))::BIGINT AS taken FROM r""",
    "op10_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS x FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM c GROUP BY id) m ON m.id = d.doc_id""",
    # levels by recursion; a leaf's siblings are numbered from the leaf to the root
    "op11_merkle_manifest": f"""
WITH RECURSIVE l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
               CASE WHEN n_chars IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS now
        FROM documents)),
t AS (SELECT lang, 0::BIGINT AS lv, pos AS i, leaf AS h, n FROM l UNION ALL
      SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lv, i // 2, n),
s AS (SELECT lang, h AS subroot, lv AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0::BIGINT AS lv, pos AS i, subroot AS h, n FROM s UNION ALL
      SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lv, i // 2, n),
top AS (SELECT h AS root, lv AS height FROM u WHERE n = 1),
steps AS (
  SELECT l.lang, l.pos, k.lv AS step, (l.pos >> k.lv) & 1 AS side, t.h
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN LATERAL (SELECT unnest(range(s.height)) AS lv) AS k
  LEFT JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lv = k.lv AND t.i = xor(l.pos >> k.lv, 1)
  UNION ALL
  SELECT l.lang, l.pos, s.height + k.lv, (s.pos >> k.lv) & 1, u.h
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, top, LATERAL (SELECT unnest(range(top.height)) AS lv) AS k
  LEFT JOIN u ON u.lv = k.lv AND u.i = xor(s.pos >> k.lv, 1)),
f AS (SELECT lang, pos, 0::BIGINT AS step, now AS h FROM l UNION ALL
      SELECT f.lang, f.pos, f.step + 1, sha256(CASE WHEN p.h IS NULL THEN f.h WHEN p.side = 1 THEN p.h || f.h ELSE f.h || p.h END)
      FROM f JOIN steps p ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos AND p.step = f.step),
e AS (SELECT lang, pos, arg_max(h, step) AS folded_root FROM f GROUP BY lang, pos),
q AS (SELECT lang, pos, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, s.subroot, top.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN e ON e.lang IS NOT DISTINCT FROM l.lang AND e.pos = l.pos
LEFT JOIN q ON q.lang IS NOT DISTINCT FROM l.lang AND q.pos = l.pos, top""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t, n_docs),
q AS (SELECT q, item_id, t, count(*) AS times
      FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY q, item_id, t),
s AS (SELECT q.q, q.item_id, n.r, n.doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN p USING (t) JOIN n ON n.r = p.r, a GROUP BY q.q, q.item_id, n.r, n.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}
