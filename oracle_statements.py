"""DuckDB statements that restate each registered query independently.

They are the correctness oracle run next to the Spark plans (tables are
registered as views under their own names) and take nothing from the package under
test: word lists, prompts and formats are stated here again.  The folds are
re-expressed with ``list_reduce``.  DuckDB's regex engine has no lookaround, so the
word-wrap oracle marks hyphen and em-dash break points with a control character first.
"""

from __future__ import annotations

# --- fixed values: white space, word tokens, question rules, prompts -----------
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}]+"
WHO_WORDS = ["he", "she", "they", "person", "people"]
WHAT_WORDS = ["what", "which", "how"]
WHEN_WORDS = ["today", "yesterday", "year", "month"]
WHERE_WORDS = ["where", "location", "place", "city", "country"]
WHO_QUESTION = "Who is mentioned in this text?"
WHAT_QUESTION = "What is the main topic discussed?"
WHEN_QUESTION = "When did this occur?"
WHERE_QUESTION = "Where did this take place?"
DEFAULT_QUESTIONS = ["What is the main point of this text?",
                     "What information is provided in this passage?"]
NOT_AVAILABLE = "Not available"
#: Digits that are not decimal (superscripts, circled and the like): No characters
#: with a digit value, by Unicode's own property.
DIGIT_CLASS = "[\\p{Nd}" + "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal()) + "]"
FEW_SHOT_HEAD = (
    "Answer the question using only the context. If the context does not contain "
    "the answer, reply 'Not available'.\n\n"
    "Context:\nThe library opens at nine and closes at five on weekdays.\n"
    "Question: When does the library close on weekdays?\n"
    "Answer: At five.\n\n"
    "Context:\nThe bridge was painted green in the spring.\n"
    "Question: Who designed the bridge?\n"
    "Answer: Not available\n\n"
    "Context:\n")
# ---------------------------------------------------------------------------------

LETTER_RE2 = r"[\p{L}\p{Nl}\p{No}_]"
WORD_RE2 = r"[\p{L}\p{N}_]"
WORD_PUNCT_RE2 = r"""[\p{L}\p{N}_!"'&.,?]"""


def lit(s: str) -> str:
    """SQL string literal; control characters spelled with chr()."""
    out, buf = [], []
    for ch in s:
        if ch == "'":
            buf.append("''")
        elif ord(ch) < 32:
            if buf:
                out.append("'" + "".join(buf) + "'")
                buf = []
            out.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not out:
        out.append("'" + "".join(buf) + "'")
    return "(" + " || ".join(out) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+\\z')}, '', 'g')"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(WS + '+')}), lambda _t: _t <> '')"


def blank(x: str) -> str:
    return f"regexp_full_match({x}, {lit(WS + '*')})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TOKEN)}, 0)"


def iso(ts: str) -> str:
    return (f"CASE WHEN strftime({ts}, '%f') = '000000' THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


def bucket(tok: str, dim: int = 64) -> str:
    return f"((('0x' || substr(md5({tok}), 1, 8))::BIGINT) % {dim})::INTEGER"


def split_hash(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 15))::BIGINT)"


def sentence_pack(text: str, max_length: int = 512, min_length: int = 50) -> str:
    sents = (f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?]+'), "
             f"lambda _s: {strip('_s')}), lambda _s: _s <> '')")
    fold = (f"list_reduce({sents}, lambda acc, s: CASE WHEN length(acc.cur) + length(s) < {max_length} "
            f"THEN {{'chunks': acc.chunks, 'cur': acc.cur || s || '. '}} "
            f"ELSE {{'chunks': CASE WHEN acc.cur <> '' THEN list_append(acc.chunks, {strip('acc.cur')}) "
            f"ELSE acc.chunks END, 'cur': s || '. '}} END, "
            f"{{'chunks': []::VARCHAR[], 'cur': ''}})")
    return (f"list_filter((SELECT CASE WHEN f.cur <> '' THEN list_append(f.chunks, {strip('f.cur')}) "
            f"ELSE f.chunks END FROM (SELECT {fold} AS f)), lambda _c: length(_c) > {min_length})")


def sentence_spans(ctx: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({ctx}, '[^.!?]+[.!?]*', 0), "
            f"lambda _s: {strip('_s')}), lambda _s: _s <> '')")


def rule_questions(text: str) -> str:
    words = split_ws(text)
    lw = f"list_transform({words}, lambda _w: lower(_w))"

    def arr(xs):
        return "[" + ", ".join(lit(x) for x in xs) + "]"
    who = f"list_has_any({lw}, {arr(WHO_WORDS)})"
    what = f"list_has_any({lw}, {arr(WHAT_WORDS)})"
    when = (f"(coalesce(list_bool_or(list_transform({words}, lambda _w: regexp_full_match(_w, {lit(DIGIT_CLASS + '+')}))), false) "
            f"OR list_has_any({lw}, {arr(WHEN_WORDS)}))")
    where = f"list_has_any({lw}, {arr(WHERE_WORDS)})"
    fired = (f"list_filter([CASE WHEN {who} THEN {lit(WHO_QUESTION)} END, "
             f"CASE WHEN {what} THEN {lit(WHAT_QUESTION)} END, "
             f"CASE WHEN {when} THEN {lit(WHEN_QUESTION)} END, "
             f"CASE WHEN {where} THEN {lit(WHERE_QUESTION)} END], lambda _q: _q IS NOT NULL)")
    return (f"(SELECT CASE WHEN len(fq) = 0 THEN {arr(DEFAULT_QUESTIONS)} ELSE fq[1:3] END "
            f"FROM (SELECT {fired} AS fq))")


def best_sentence_cols(question: str, ctx: str) -> str:
    """SELECT-list fragment producing answer, overlap, score from columns."""
    return f"""(SELECT {{'answer': coalesce(sents[list_position(sc, list_max(sc))], ''),
                  'overlap': coalesce(list_max(sc), 0),
                  'score': CASE WHEN len(qt) > 0 THEN coalesce(list_max(sc), 0) / len(qt) ELSE 0.0 END}}
        FROM (SELECT sents, qt, list_transform(sents, lambda _s: len(list_intersect(qt, list_distinct({tokens('_s')})))) AS sc
              FROM (SELECT {sentence_spans(ctx)} AS sents, list_distinct({tokens(question)}) AS qt)))"""


# --- word wrap -------------------------------------------------------------

def _munge(text: str) -> str:
    seg_expand = ("list_reduce(string_split(_seg, chr(9))[2:], "
                  "lambda acc, p: acc || repeat(' ', 8 - length(acc) % 8) || p, string_split(_seg, chr(9))[1])")
    expanded = (f"CASE WHEN instr({text}, chr(9)) > 0 THEN array_to_string(list_transform("
                f"regexp_split_to_array({text}, '[' || chr(10) || chr(13) || ']'), lambda _seg: {seg_expand}), ' ') "
                f"ELSE {text} END")
    return f"translate({expanded}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"


def wrap_tokens(text: str) -> str:
    t = _munge(text)
    hy1 = f"'({LETTER_RE2}{LETTER_RE2}-)({LETTER_RE2}-?{LETTER_RE2})'"
    hy2 = f"'({LETTER_RE2}-{LETTER_RE2}-)({LETTER_RE2}-?{LETTER_RE2})'"
    em = f"{lit('(' + WORD_PUNCT_RE2 + ')(-{2,})(' + WORD_RE2 + ')')}"
    mark = "'\\1' || chr(1) || '\\2'"
    mark3 = "'\\1' || chr(1) || '\\2' || chr(1) || '\\3'"
    x = t
    for _ in range(2):
        x = f"regexp_replace({x}, {em}, {mark3}, 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, {hy1}, {mark}, 'g')"
        x = f"regexp_replace({x}, {hy2}, {mark}, 'g')"
    return f"regexp_extract_all({x}, '( +|[^ ' || chr(1) || ']+)', 1)"


def _state(lines, cur, curlen, nparts, tailblank, taillen, fresh):
    return (f"{{'lines': {lines}, 'cur': {cur}, 'curlen': {curlen}, 'nparts': {nparts}, "
            f"'tailblank': {tailblank}, 'taillen': {taillen}, 'fresh': {fresh}}}")


def _emitted(lines, cur, curlen, nparts, tailblank, taillen):
    return (f"(CASE WHEN (CASE WHEN {tailblank} THEN {nparts} - 1 ELSE {nparts} END) > 0 "
            f"THEN list_append({lines}, CASE WHEN {tailblank} THEN substr({cur}, 1, {curlen} - {taillen}) "
            f"ELSE {cur} END) ELSE {lines} END)")


def _cut(chunk, space):
    win = f"substr({chunk}, 1, {space})"
    hyph = f"(length(regexp_extract({win}, '^.*-', 0)) - 1)"
    return (f"(CASE WHEN {hyph} > 0 AND regexp_matches(substr({win}, 1, greatest({hyph}, 0)), '[^-]') "
            f"THEN {hyph} + 1 ELSE {space} END)")


def wrap(text: str, width: int = 500) -> str:
    W = str(width)
    a = "acc"
    L, C, CL, NP, TB, TL, FR = (f"{a}.lines", f"{a}.cur", f"{a}.curlen", f"{a}.nparts",
                                f"{a}.tailblank", f"{a}.taillen", f"{a}.fresh")
    n = "length(t)"
    b = blank("t")
    closed = _emitted(L, C, CL, NP, TB, TL)
    restart = (f"CASE WHEN {b} AND len({closed}) > 0 "
               f"THEN {_state(closed, chr(39)*2, 0, 0, 'false', 0, 'false')} "
               f"ELSE {_state(closed, 't', n, 1, b, n, 'false')} END")
    space = f"({W} - {CL})"
    end = _cut("t", space)
    head = f"substr(t, 1, {end})"
    rest = f"substr(t, {end} + 1)"
    after = _emitted(L, f"({C} || {head})", f"({CL} + length({head}))", f"({NP} + 1)",
                     blank(head), f"length({head})")
    inner = (f"list_reduce(range(1, (length({rest}) // {W}) * 2 + 4), lambda pc, _i: "
             f"CASE WHEN length(pc.rest) > {W} THEN {{'pieces': list_append(pc.pieces, "
             f"substr(pc.rest, 1, {_cut('pc.rest', W)})), 'rest': substr(pc.rest, {_cut('pc.rest', W)} + 1)}} "
             f"ELSE pc END, {{'pieces': []::VARCHAR[], 'rest': {rest}}})")
    full = f"list_concat({after}, list_filter(({inner}).pieces, lambda _p: NOT {blank('_p')}))"
    carry = f"({inner}).rest"
    long_word = (f"CASE WHEN {blank(rest)} AND len({after}) > 0 "
                 f"THEN {_state(after, chr(39)*2, 0, 0, 'false', 0, 'false')} "
                 f"ELSE {_state(full, carry, f'length({carry})', 1, blank(carry), f'length({carry})', 'false')} END")
    step = (f"CASE WHEN {FR} AND {b} AND len({L}) > 0 THEN {_state(L, C, CL, NP, TB, TL, 'false')} "
            f"WHEN {CL} + {n} <= {W} THEN {_state(L, f'({C} || t)', f'({CL} + {n})', f'({NP} + 1)', b, n, 'false')} "
            f"WHEN {n} <= {W} THEN {restart} "
            f"ELSE {long_word} END")
    zero = _state("[]::VARCHAR[]", "''", 0, 0, "false", 0, "true")
    fold = f"list_reduce({wrap_tokens(text)}, lambda acc, t: {step}, {zero})"
    return (f"(SELECT {_emitted('f.lines', 'f.cur', 'f.curlen', 'f.nparts', 'f.tailblank', 'f.taillen')} "
            f"FROM (SELECT {fold} AS f))")


# --- composed statements ----------------------------------------------------

def wrap_chunks_cte(width: int = 500) -> str:
    return f"""wc AS (
  SELECT doc_id, source, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS chunk_no
  FROM (SELECT doc_id, source, {wrap('text', width)} AS w FROM documents))"""


def sentence_chunks_cte(min_doc_chars: int | None = 100) -> str:
    where = f"WHERE length({strip('text')}) >= {min_doc_chars}" if min_doc_chars else ""
    return f"""sc AS (
  SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS chunk_no
  FROM (SELECT doc_id, {sentence_pack('text')} AS p FROM documents {where}))"""


def qa_rows_cte(chunks: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, instr(context, b.answer) - 1 AS answer_start
  FROM (SELECT *, {best_sentence_cols('question', 'context')} AS b
        FROM (SELECT doc_id, chunk_no, src, context, unnest(qs) AS question,
                     generate_subscripts(qs, 1) - 1 AS q_no
              FROM (SELECT doc_id, chunk_no, src, text AS context, {rule_questions('text')} AS qs
                    FROM {chunks}))))"""


def sentence_qa_sql() -> str:
    return f"""WITH {sentence_chunks_cte()},
{qa_rows_cte('(SELECT doc_id, chunk_no, NULL AS src, text FROM sc)', 'qa')}
SELECT printf('%s_chunk_%d_qa_%d', doc_id::VARCHAR, chunk_no, q_no) AS id, doc_id, chunk_no, q_no,
       context, question, b.answer AS answer, answer_start, round(b.score, 6) AS score
FROM qa"""


def wrapped_qa_sql() -> str:
    return f"""WITH {wrap_chunks_cte()},
{qa_rows_cte('(SELECT doc_id, chunk_no, source AS src, text FROM wc)', 'qa')}
SELECT md5(concat_ws(chr(1), doc_id::VARCHAR, chunk_no::VARCHAR, q_no::VARCHAR)) AS id,
       src AS title, context, question, b.answer AS answer_text, answer_start
FROM qa"""


def normalize(x: str) -> str:
    punct = "[" + "".join("\\" + ch for ch in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]"
    s = f"regexp_replace(lower({x}), {lit(punct)}, '', 'g')"
    art = f"{lit('(^|[^' + WORD_RE2[1:-1] + '])(a|an|the)([^' + WORD_RE2[1:-1] + ']|$)')}"
    for _ in range(2):
        s = f"regexp_replace({s}, {art}, '\\1 \\3', 'g')"
    return f"array_to_string({split_ws(s)}, ' ')"


def rag_index_ctes(width: int = 500, dim: int = 64, k: str = "3") -> str:
    return f"""{wrap_chunks_cte(width)},
ix AS (
  SELECT (doc_id << 20) + chunk_no AS vec_id, doc_id, chunk_no, text,
         {dense_embedding('text', dim)} AS emb
  FROM wc),
qs AS (SELECT item_id AS qid, text AS query, {dense_embedding('text', dim)} AS emb FROM benchmark),
dist AS (
  SELECT qs.qid, ix.vec_id,
         list_reduce(list_transform(range(1, {dim} + 1),
             lambda i: (qs.emb[i]::DOUBLE - ix.emb[i]::DOUBLE) * (qs.emb[i]::DOUBLE - ix.emb[i]::DOUBLE)),
             lambda a, d: a + d, 0.0::DOUBLE) AS dist
  FROM qs, ix),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), vec_id) AS rank
                 FROM dist) WHERE rank <= {k}),
ctx AS (
  SELECT top.qid, string_agg(ix.text, chr(10) ORDER BY top.rank) AS context, count(*) AS n_hits
  FROM top JOIN ix USING (vec_id) GROUP BY top.qid)"""


def dense_embedding(text: str, dim: int = 64) -> str:
    counts = (f"list_transform(range({dim}), lambda i: len(list_filter(list_transform({tokens(text)}, "
              f"lambda _k: {bucket('_k', dim)}), lambda _b: _b = i)))")
    return (f"(SELECT list_transform(c, lambda x: CASE WHEN nrm > 0 THEN (x / nrm)::FLOAT ELSE 0.0::FLOAT END) "
            f"FROM (SELECT c, sqrt(list_sum(list_transform(c, lambda x: (x * x)::DOUBLE))) AS nrm "
            f"FROM (SELECT {counts} AS c)))")


def statements() -> dict[str, str]:
    strip_text = strip("text")
    url_path = "regexp_replace(url, '[?#].*$', '')"
    base = f"string_split({url_path}, '/')[-1]"
    trimmed = f"regexp_replace({url_path}, '(/+\\.?)+$', '')"
    pure = (f"CASE WHEN string_split({trimmed}, '/')[-1] = '.' THEN '' "
            f"ELSE string_split({trimmed}, '/')[-1] END")
    sfx = f"regexp_extract({pure}, '^.+(\\.[^.]+)$', 1)"
    return {
        "knn_topk": """
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS qid, c.vec_id AS vec_id,
        list_reduce(list_transform(range(1, len(q.embedding) + 1),
          lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE)),
          lambda a, x: a + x, 0.0::DOUBLE) AS dist
      FROM e q, e c WHERE len(q.embedding) = len(c.embedding))
SELECT qid, rank::BIGINT AS rank, vec_id, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), vec_id) AS rank FROM d)
WHERE rank <= 3""",
        "knn_topk_dirty": """
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 50 NOT IN (1, 2, 3)),
d AS (SELECT q.vec_id AS qid, c.vec_id AS vec_id,
        list_reduce(list_transform(range(1, len(q.embedding) + 1),
          lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE)),
          lambda a, x: a + x, 0.0::DOUBLE) AS dist
      FROM e q, e c WHERE q.vec_id % 50 <> 4)
SELECT qid, rank::BIGINT AS rank, vec_id, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), vec_id) AS rank FROM d)
WHERE rank <= 3""",
        "index_stats": """
SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
       count(*) FILTER (WHERE embedding IS NULL) AS n_null,
       min(len(embedding)) = max(len(embedding)) AS uniform
FROM embeddings""",
        "argmax_em": """
SELECT count(*) AS n,
       round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1.0 ELSE 0.0 END), 6)
         AS exact_match
FROM embeddings""",
        "ext_filter": f"SELECT page_id, url FROM pages WHERE lower({sfx}) IN ('.html')",
        "ext_audit": f"""
SELECT lower({sfx}) AS ext, count(*) AS n_files FROM pages
WHERE lower({sfx}) NOT IN ('.html') GROUP BY 1""",
        "path_parts": f"""
SELECT page_id, {base} AS basename,
       substr({pure}, 1, length({pure}) - length({sfx})) AS stem, lower({sfx}) AS ext,
       concat_ws('/', 'pages', regexp_replace(regexp_replace({url_path}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '^/+', '')) AS key
FROM pages""",
        "min_text_filter": f"""
SELECT doc_id, length({strip_text}) AS stripped_len FROM documents WHERE length({strip_text}) >= 100""",
        "text_prefix": "SELECT doc_id, substr(text, 1, 1000) AS prefix FROM documents",
        "qgen_prompt": f"""
SELECT doc_id, {lit('Write 3 questions that the following passage answers, one per line.' + chr(10))}
       || substr(text, 1, 1000) AS prompt FROM documents""",
        "page_concat": """
SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text, count(*) AS n_pages
FROM conversations GROUP BY conv_id""",
        "page_concat_nl": """
SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text, count(*) AS n_pages
FROM conversations GROUP BY conv_id""",
        "corpus_union": """
SELECT 'documents' AS corpus, doc_id, text FROM documents
UNION ALL
SELECT 'conversations' AS corpus, conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
        "incremental_anti": """
SELECT d.doc_id, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
        "quarantine": f"""
SELECT doc_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'quarantine' END AS status, reason
FROM (SELECT doc_id,
        CASE WHEN text IS NULL THEN 'null_text'
             WHEN length({strip_text}) = 0 THEN 'blank_text'
             WHEN length({strip_text}) < 100 THEN 'too_short' END AS reason
      FROM documents)""",
        "latest_status": f"""
SELECT task_id, status, CASE WHEN status IN ('error', 'failed') THEN err END AS error_message,
       {iso('ts')} AS updated_at, n_events
FROM (SELECT user_id AS task_id, event_type AS status, props AS err, ts,
             count(*) OVER (PARTITION BY user_id) AS n_events,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1""",
        "run_counters": """
SELECT user_id AS task_id, count(*) AS total,
       count(*) FILTER (WHERE event_type NOT IN ('error', 'failed')) AS processed,
       count(*) FILTER (WHERE event_type IN ('error', 'failed')) AS failed,
       round(sum(value), 6) AS value_sum
FROM events GROUP BY user_id""",
        "status_progress": f"""
SELECT user_id AS task_id, {iso('min(ts)')} AS started_at, {iso('max(ts)')} AS last_update_at
FROM events GROUP BY user_id""",
        "active_tasks": """
SELECT status, count(*) AS n_tasks, status NOT IN ('completed', 'failed', 'inference_ready', 'error') AS active
FROM (SELECT event_type AS status,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1 GROUP BY status""",
        "parse_questions": f"""
SELECT doc_id, unnest(qs) AS question, generate_subscripts(qs, 1) - 1 AS q_no
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda _s: {strip('_s')}),
                                 lambda _q: _q <> '')[1:3] AS qs FROM documents)""",
        "truncate_tokens": f"""
SELECT doc_id, array_to_string({split_ws('text')}[1:512], ' ') AS text FROM documents""",
        "token_windows": f"""
SELECT doc_id, win_no, tok_start, len(w) AS n_tokens, array_to_string(w, ' ') AS text
FROM (SELECT doc_id, win_no, tok_start, toks[tok_start + 1 : tok_start + 384] AS w
      FROM (SELECT doc_id, toks, unnest(starts) AS tok_start, generate_subscripts(starts, 1) - 1 AS win_no
            FROM (SELECT doc_id, toks,
                         list_transform(range(0, greatest(ceil((len(toks) - 384) / 256)::INTEGER, 0) + 1),
                                        lambda i: i * 256) AS starts
                  FROM (SELECT doc_id, {split_ws('text')} AS toks FROM documents))))""",
        "sentence_pack": f"""WITH {sentence_chunks_cte(None)}
SELECT doc_id, chunk_no, text FROM sc""",
        "rule_questions": f"""WITH {sentence_chunks_cte()}
SELECT doc_id, chunk_no, unnest(qs) AS question, generate_subscripts(qs, 1) - 1 AS q_no
FROM (SELECT doc_id, chunk_no, {rule_questions('text')} AS qs FROM sc)""",
        "qa_pairs": sentence_qa_sql(),
        "squad_nested": f"""WITH q AS ({sentence_qa_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY doc_id, chunk_no, q_no) - 1 AS position,
             count(*) OVER (PARTITION BY context) AS n_qas FROM q),
p AS (SELECT context, n_qas, row_number() OVER (ORDER BY doc_id, chunk_no, q_no) - 1 AS paragraph_no FROM r WHERE position = 0)
SELECT 'paragraph' AS kind, paragraph_no, NULL AS position, 'Generated_Document_corpus' AS title, context, n_qas,
       NULL AS id, NULL AS question, NULL AS answer, NULL AS answer_start FROM p
UNION ALL
SELECT 'question', p.paragraph_no, r.position, NULL, NULL, NULL, r.id, r.question, r.answer, r.answer_start FROM r JOIN p USING (context)""",
        "squad_document": f"""WITH q AS ({sentence_qa_sql()})
SELECT 'Generated_Document_corpus' AS title, context, id, question, answer, answer_start FROM q""",
        "read_squad_flat": wrapped_qa_sql(),
        "index_round_trip": f"""WITH {wrap_chunks_cte()}
SELECT wc.doc_id, wc.chunk_no, d.source, wc.text, 64::BIGINT AS dim FROM wc JOIN documents d USING (doc_id)""",
        "answer_offset": f"""WITH {wrap_chunks_cte()}
SELECT wc.doc_id, wc.chunk_no,
       CASE WHEN wc.chunk_no % 7 = 6 THEN 0 ELSE instr(d.text, wc.text) - 1 END::BIGINT AS answer_start
FROM wc JOIN documents d USING (doc_id)""",
        "train_eval_split": f"""WITH q AS ({sentence_qa_sql()})
SELECT id, CASE WHEN (('0x' || substr(md5(id), 1, 8))::BIGINT) % 10 = 0 THEN 'eval' ELSE 'train' END AS split
FROM q""",
        "squad_em_f1": f"""WITH q AS ({sentence_qa_sql()}),
ev AS (SELECT id, answer AS answer_text, CASE WHEN (('0x' || substr(md5(id), 9, 8))::BIGINT) % 3 <> 0 THEN ({sentence_spans('context')})[1] END AS prediction_text,
              (('0x' || substr(md5(id), 9, 8))::BIGINT) % 3 = 0 AS absent FROM q
       WHERE (('0x' || substr(md5(id), 1, 8))::BIGINT) % 10 = 0),
nz AS (SELECT id, absent, {normalize("coalesce(prediction_text, '')")} AS p, {normalize('answer_text')} AS g FROM ev),
tk AS (SELECT id, absent, p, g, {split_ws('p')} AS pt, {split_ws('g')} AS gt FROM nz),
sc AS (SELECT id, absent, CASE WHEN p = g AND NOT absent THEN 1.0 ELSE 0.0 END AS em,
              coalesce(list_sum(list_transform(list_distinct(pt), lambda t:
                 least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))), 0) AS common,
              len(pt) AS np, len(gt) AS ng FROM tk)
SELECT count(*) AS n, count(*) FILTER (WHERE absent) AS n_missing, count(*) - count(DISTINCT id) AS n_dup_ids,
       round(avg(em) * 100, 6) AS exact_match,
       round(avg(CASE WHEN common = 0 OR absent THEN 0.0
                      ELSE 2 * (common / np) * (common / ng) / ((common / np) + (common / ng)) END) * 100, 6) AS f1
FROM sc""",
        "wrap_chunks": f"""WITH {wrap_chunks_cte()}
SELECT doc_id, chunk_no, text FROM wc""",
        "hash_embed": f"""
WITH t AS (SELECT doc_id, unnest({tokens('text')}) AS tok FROM documents),
b AS (SELECT doc_id, {bucket('tok')} AS bucket, count(*) AS cnt FROM t GROUP BY ALL)
SELECT doc_id, bucket::BIGINT AS bucket,
       round((cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 6) AS weight
FROM b""",
        "qa_flat": wrapped_qa_sql(),
        "qa_flat_json": f"""WITH f AS ({wrapped_qa_sql()})
SELECT id, to_json({{'id': id, 'title': title, 'context': context, 'question': question,
                    'answers': {{'text': [answer_text], 'answer_start': [answer_start::INTEGER]}}}})::VARCHAR AS json
FROM f""",
        "train_examples": f"""WITH f AS ({wrapped_qa_sql()}),
g AS (SELECT md5(concat_ws(chr(1), doc_id::VARCHAR, chunk_no::VARCHAR, q_no::VARCHAR)) AS id, question, b.answer AS answer_text, doc_id
      FROM (WITH {wrap_chunks_cte()}, {qa_rows_cte('(SELECT doc_id, chunk_no, source AS src, text FROM wc)', 'qa')} SELECT * FROM qa))
SELECT g.id, d.text AS context, g.question, g.answer_text, instr(d.text, g.answer_text) - 1 AS answer_start
FROM g JOIN documents d USING (doc_id) WHERE instr(d.text, g.answer_text) > 0 OR g.answer_text = ''""",
        "extract_answer": f"""WITH t AS (
  SELECT conv_id AS doc_id, turn AS chunk_no, CASE WHEN turn % 5 = 4 THEN '' ELSE coalesce(text, '') END AS text FROM conversations),
{qa_rows_cte('(SELECT doc_id, chunk_no, NULL AS src, text FROM t)', 'qa')}
SELECT doc_id AS conv_id, chunk_no AS turn, q_no, question, b.answer AS answer, round(b.score, 6) AS score,
       CASE WHEN b.answer = '' THEN 0 ELSE instr(lower(context), b.answer) - 1 END AS answer_start
FROM qa""",
        "train_eval_exact": f"""WITH q AS ({sentence_qa_sql()})
SELECT id, CASE WHEN row_number() OVER (ORDER BY {split_hash('id', 0)}, id) <= ceil(count(*) OVER () / 10.0) THEN 'eval' ELSE 'train' END AS split
FROM q""",
        "train_eval_by_document": f"""WITH {sentence_chunks_cte(None)},
u AS (SELECT doc_id, row_number() OVER (ORDER BY {split_hash('doc_id::VARCHAR', 7)}, doc_id) AS place, count(*) OVER () AS n
      FROM (SELECT DISTINCT doc_id FROM sc))
SELECT sc.doc_id, sc.chunk_no, CASE WHEN place <= ceil(n / 4.0) THEN 'eval' ELSE 'train' END AS split FROM sc JOIN u USING (doc_id)""",
        "squad_best_of": f"""WITH q AS ({sentence_qa_sql()}),
ev AS (SELECT id, answer, question, ({sentence_spans('context')})[1] AS first, (('0x' || substr(md5(id), 9, 8))::BIGINT) % 12 AS m
       FROM q WHERE (('0x' || substr(md5(id), 1, 8))::BIGINT) % 10 = 0),
g AS (SELECT id, m = 5 AS absent,
             CASE m % 4 WHEN 0 THEN 'The ' || answer || '!' WHEN 1 THEN concat_ws(' ', question, answer) ELSE first END AS said,
             unnest(list_filter([answer, CASE WHEN m % 3 <> 0 THEN first END, CASE WHEN m % 3 = 1 THEN question END], lambda x: x IS NOT NULL)) AS gold
      FROM ev),
nz AS (SELECT id, absent, {normalize("coalesce(said, '')")} AS p, {normalize('gold')} AS g FROM g),
tk AS (SELECT id, absent, p, g, {split_ws('p')} AS pt, {split_ws('g')} AS gt FROM nz),
sc AS (SELECT id, absent, p = g AS same, coalesce(list_sum(list_transform(list_distinct(pt), lambda t:
                 least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))), 0) AS common,
              len(pt) AS np, len(gt) AS ng FROM tk),
b AS (SELECT id, any_value(absent) AS absent, count(*) AS n_answers, max(CASE WHEN same AND NOT absent THEN 1.0 ELSE 0.0 END) AS em,
             max(CASE WHEN common = 0 OR absent THEN 0.0
                      ELSE 2 * (common / np) * (common / ng) / ((common / np) + (common / ng)) END) AS f1
      FROM sc GROUP BY id)
SELECT count(*) AS n, sum(n_answers) AS n_answers, count(*) FILTER (WHERE absent) AS n_missing, 0 AS n_dup_ids,
       round(avg(em) * 100, 6) AS exact_match, round(avg(f1) * 100, 6) AS f1 FROM b""",
        "knn_topk_mixed": """
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS qid, c.vec_id AS vec_id,
        list_reduce(list_transform(range(1, len(q.embedding) + 1),
          lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE)),
          lambda a, x: a + x, 0.0::DOUBLE) AS dist
      FROM e q, e c WHERE len(q.embedding) = len(c.embedding))
SELECT qid, rank::BIGINT AS rank, vec_id, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), vec_id) AS rank FROM d)
WHERE rank <= CASE WHEN qid = 5 THEN 1000000 WHEN qid % 7 <> 6 THEN qid % 7 ELSE 3 END""",
        "page_extract": """
WITH p AS (
  SELECT page_id, CASE WHEN instr(html, '</html>') = 0 THEN 'ValueError: document breaks off' END AS broken,
         regexp_extract_all(html, '<p>([^<>]*)</p>', 1) AS paras,
         CASE WHEN instr(body, '&amp;&amp;') > 0 THEN 'ValueError: repeated entities' END AS garbled, regexp_replace(body, '<[^<>]*>', ' ', 'g') AS bare
  FROM (SELECT *, substr(html, instr(html, '<body>') + 6) AS body FROM pages)),
r AS (SELECT *, coalesce(broken, CASE WHEN len(list_filter(paras, lambda x: x <> '')) = 0 THEN 'empty' END) AS first,
             coalesce(garbled, CASE WHEN bare = '' THEN 'empty' END) AS second FROM p),
pages_of AS (SELECT page_id, CASE WHEN first IS NULL THEN 0 WHEN second IS NULL THEN 1 ELSE -1 END AS attempt,
                    CASE WHEN first IS NULL THEN paras WHEN second IS NULL THEN [bare] ELSE [''] END AS texts FROM r)
SELECT page_id, 'failure' AS kind, NULL AS page_no, NULL AS text, 0 AS attempt, first AS reason FROM r WHERE first IS NOT NULL
UNION ALL
SELECT page_id, 'failure', NULL, NULL, 1, second FROM r WHERE first IS NOT NULL AND second IS NOT NULL
UNION ALL
SELECT page_id, 'page', unnest(range(len(texts))), unnest(texts), attempt, NULL FROM pages_of""",
        "task_status": f"""
WITH e AS (
  SELECT user_id AS task_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'progress'
                                             WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS ev, ts, event_id, floor(value)::BIGINT AS x, props
  FROM events),
l AS (SELECT task_id, max(ts) AS last, list({{'ev': ev, 'ts': ts, 'x': x, 'm': props}} ORDER BY ts, event_id) AS evs FROM e GROUP BY task_id),
s AS (SELECT task_id, last, list_reduce(evs, lambda a, e:
  CASE WHEN e.ev = 'pending' AND (a.st IS NULL OR a.st IN ('completed', 'failed')) THEN
         {{'run': a.run + 1, 'st': 'pending', 'done': 0::BIGINT, 'made': 0::BIGINT, 'err': NULL::VARCHAR, 'b': e.ts, 'c': NULL::TIMESTAMP, 'bad': a.bad}}
       WHEN e.ev = 'running' AND a.st = 'pending' THEN
         {{'run': a.run, 'st': 'running', 'done': a.done, 'made': a.made, 'err': a.err, 'b': a.b, 'c': a.c, 'bad': a.bad}}
       WHEN e.ev = 'progress' AND a.st = 'running' THEN
         {{'run': a.run, 'st': a.st, 'done': a.done + 1, 'made': a.made + e.x, 'err': a.err, 'b': a.b, 'c': a.c, 'bad': a.bad}}
       WHEN e.ev = 'completed' AND a.st = 'running' THEN
         {{'run': a.run, 'st': 'completed', 'done': a.done, 'made': a.made, 'err': NULL::VARCHAR, 'b': a.b, 'c': e.ts, 'bad': a.bad}}
       WHEN e.ev = 'failed' AND a.st IN ('pending', 'running') THEN
         {{'run': a.run, 'st': 'failed', 'done': a.done, 'made': a.made, 'err': e.m, 'b': a.b, 'c': e.ts, 'bad': a.bad}}
       ELSE {{'run': a.run, 'st': a.st, 'done': a.done, 'made': a.made, 'err': a.err, 'b': a.b, 'c': a.c, 'bad': a.bad + 1}} END,
  {{'run': 0::BIGINT, 'st': NULL::VARCHAR, 'done': 0::BIGINT, 'made': 0::BIGINT, 'err': NULL::VARCHAR, 'b': NULL::TIMESTAMP, 'c': NULL::TIMESTAMP,
   'bad': 0::BIGINT}}) AS a FROM l)
SELECT task_id, a.run AS run_no, a.st AS status, 0 AS total_files, a.done AS processed_files, a.made AS generated_examples,
       a.err AS error_message, {iso('a.b')} AS started_at, {iso('a.c')} AS completed_at, a.bad AS n_illegal, 0 AS n_late,
       coalesce(a.st IN ('pending', 'running'), false)
         AND epoch_ms(last) + 6 * 3600000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events) AS stale
FROM s""",
        "rag_index_stats": f"""WITH {wrap_chunks_cte()},
ix AS (SELECT {dense_embedding('text')} AS embedding FROM wc)
SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
       count(*) FILTER (WHERE embedding IS NULL) AS n_null,
       min(len(embedding)) = max(len(embedding)) AS uniform
FROM ix""",
        "qa_token_windows": f"""WITH {qa_rows_cte("(SELECT doc_id, 0 AS chunk_no, NULL AS src, text FROM documents)", 'qa')},
piece AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, {lit('(?:' + WS + ')+|[^' + WS[1:-1] + ']+')}) AS ps FROM documents)),
spot AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS ce FROM piece),
tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS t, ce - length(piece) AS cs, ce
        FROM spot WHERE NOT {blank('piece')}),
ex AS (SELECT md5(concat_ws(chr(1), qa.doc_id::VARCHAR, q_no::VARCHAR)) AS id, qa.doc_id, context, question, 384 - len({split_ws('question')}) AS bud,
              answer_start AS a, answer_start + length(b.answer) AS z, b.answer <> '' AS answered, coalesce(n, 0) AS n
       FROM qa LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) USING (doc_id) WHERE answer_start <> -1),
ans AS (SELECT ex.id, min(t) AS f, max(t) AS l FROM ex JOIN tok ON tok.doc_id = ex.doc_id AND answered AND ce > a AND cs < z GROUP BY ex.id),
win AS (SELECT *, win_no * (bud - 128) AS lo, least(win_no * (bud - 128) + bud, n) AS hi
        FROM (SELECT *, unnest(range(greatest(ceil((n - bud) / (bud - 128))::BIGINT, 0) + 1)) AS win_no FROM ex))
SELECT win.id, win_no, question, lo AS tok_start, hi - lo AS n_tokens, coalesce(x.cs, 0)::BIGINT AS char_start, coalesce(y.ce, 0)::BIGINT AS char_end,
       CASE WHEN x.cs IS NULL THEN '' ELSE substr(context, x.cs::BIGINT + 1, (y.ce - x.cs)::BIGINT) END AS text,
       CASE WHEN f >= lo AND l < hi THEN f - lo ELSE -1 END AS answer_first, CASE WHEN f >= lo AND l < hi THEN l - lo ELSE -1 END AS answer_last
FROM win LEFT JOIN ans ON ans.id = win.id LEFT JOIN tok x ON x.doc_id = win.doc_id AND x.t = lo AND lo < hi
LEFT JOIN tok y ON y.doc_id = win.doc_id AND y.t = hi - 1 AND lo < hi""",
        "rag_context_mixed": f"""WITH {rag_index_ctes(k="CASE WHEN qid % 6 <> 5 THEN qid % 6 ELSE 3 END")}
SELECT qid, context, n_hits FROM ctx""",
        "rag_context": f"""WITH {rag_index_ctes()}
SELECT qid, context, n_hits FROM ctx""",
        "rag_prompt": f"""WITH {rag_index_ctes()},
a AS (SELECT qs.qid, qs.query, coalesce(ctx.context, '') AS context FROM qs LEFT JOIN ctx USING (qid))
SELECT qid,
       'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Answer:'
         AS zero_shot,
       array_to_string({split_ws(lit(FEW_SHOT_HEAD) + " || context || chr(10) || 'Question: ' || query || chr(10) || 'Answer:'")}[1:512], ' ')
         AS few_shot_truncated
FROM a""",
        "rag_answer": f"""WITH {rag_index_ctes()},
a AS (SELECT qs.qid, qs.query, coalesce(ctx.context, '') AS context FROM qs LEFT JOIN ctx USING (qid))
SELECT qid, query, context,
       CASE WHEN b.overlap > 0 THEN b.answer ELSE {lit(NOT_AVAILABLE)} END AS response
FROM (SELECT *, {best_sentence_cols('query', 'context')} AS b FROM a)""",
    }
