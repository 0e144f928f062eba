"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from veritally.llm.alignment import op12_cross_tokenizer_alignment
from veritally.llm.chat_format import CONTROL, MARKS, op13_chat_formatting
from veritally.llm.decontaminate import op7_benchmark_decontamination
from veritally.llm.embed_dedup import op2_embedding_near_dedup
from veritally.llm.html_text import op8_html_extraction
from veritally.llm.mixing import op1_mixing_sources
from veritally.llm.ngram_join import op9_ngram_jaccard_join
from veritally.llm.quality import op10_quality_classifier
from veritally.llm.secrets import op4_secret_scans
from veritally.llm.spelling import op11_spelling_variants
from veritally.llm.tokens import op6_token_counts
from veritally.llm.url_filter import op3_url_filters
from veritally.llm.warc import op5_warc

QUERIES = {
    "op1_mixing_sources": op1_mixing_sources,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_secret_scans": op4_secret_scans,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_chat_formatting": op13_chat_formatting,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_MARKS = sum(map(len, MARKS))
_CONTROL = r"([<\[])(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"

ORACLE_SQL = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op9_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM g),
p AS (SELECT doc_id, unnest(s) AS x FROM g),
r AS (SELECT * FROM p WHERE x IN (SELECT x FROM p GROUP BY x HAVING count(*) > 1)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
g AS (SELECT doc_id, r, count(*) AS n FROM r WHERE length(r) >= 7 GROUP BY ALL),
x AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM g),
h AS (SELECT r, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h
      FROM x, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, i, word[:i] || word[i + 2:] AS d FROM v, unnest(range(length(word))) AS u(i)),
p AS (SELECT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.d UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.d
      UNION SELECT a.word, b.word FROM d a JOIN d b ON a.d = b.d AND a.i = b.i AND a.word <> b.word),
o AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS c FROM p JOIN v ON v.word = b),
f AS (SELECT v.word, v.n, coalesce(c, 0) AS n_near, CASE WHEN o.n >= 10 * v.n THEN b END AS form, CASE WHEN o.n >= 10 * v.n THEN o.n END AS form_n FROM v LEFT JOIN o ON a = v.word AND k = 1),
z AS (SELECT word, word AS root FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT f.*, z.root FROM f JOIN z USING (word) JOIN f e ON e.word = z.root WHERE e.form IS NULL""",
    "op13_chat_formatting": rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM c),
s AS (SELECT *, {_MARKS} + length(regexp_replace(r, '{_CONTROL}', '\1\\\2\3', 'g')) + length(regexp_replace(t, '{_CONTROL}', '\1\\\2\3', 'g')) AS n, sha256(r || chr(10) || t) AS tie FROM t),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, tie)) AS turns_sha256,
             coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, tie) FILTER (r = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a""",
}
