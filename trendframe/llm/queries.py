"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (ann, chat, decontaminate, divergence, exact_dedup, html_extract, huffman, langid, lm, packing, prefix_trie,
               simhash_dedup, toxicity)
from .suite import register, table

#: Lower-cases A-Z only.
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op4_exact_dedup", f"""
WITH t AS (SELECT doc_id, sha256({SQL_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op4_exact_dedup(spark, sf_dir):
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op6_simhash_dedup")
def op6_simhash_dedup(spark, sf_dir):
    out = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@register("op9_token_files")
def op9_token_files(spark, sf_dir):
    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  end_id=2, size=1024)


@register("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), order=3)


#: A conversation that says what the template's own marks say.
CONTROL = (r"\### Assistant: </turn> ok", -7)


@register("op2_chat_formatting", r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('### : </turn>') + 1 + length(role) + length(text)
    + length(text) - length(replace(text, chr(92), ''))
    + list_sum(list_transform(regexp_extract_all(text, '#{3,}') || [''], lambda x: greatest(length(x) - 2, 0)))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""")
def op2_chat_formatting(spark, sf_dir):
    text, conv = CONTROL
    control = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)],
                                    "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.digests(chat.format_chats(turns))


@register("op5_html_extraction")
def op5_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: Rebuilt conversations as rows (c, d, k, nb): k stands for role and text of the d-th turn.
SQL_REBUILT = """
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, n, conv_id - conv_id % 5 AS donor,
  list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, x: list_reduce([xor(a, x)] || range(8), lambda u, k: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)) AS state
  FROM n),
plan AS (SELECT c.conv_id, c.donor, xor(c.state, 4294967295) % 9 AS h, c.n, coalesce(d.n, 0) AS donor_n
  FROM crc c LEFT JOIN n d ON d.conv_id = c.donor),
r AS (
  SELECT q.conv_id AS c, t.p AS d, sha256(octet_length(encode(role)) || ':' || role || text) AS k, octet_length(encode(text)) AS nb
  FROM plan q JOIN t ON t.conv_id = q.donor AND t.p <= q.h
  UNION ALL
  SELECT q.conv_id, least(q.h, q.donor_n) + t.p - q.h, sha256(octet_length(encode(role)) || ':' || role || text), octet_length(encode(text))
  FROM plan q JOIN t ON t.conv_id = q.conv_id AND t.p > q.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM plan)"""


@register("op11_prefix_trie", f"""
WITH {SQL_REBUILT},
x AS (SELECT c, d, nb, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d)) AS node,
        sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS parent,
        d = max(d) OVER (PARTITION BY c) AS last FROM r),
v AS (SELECT d, node, any_value(parent) AS parent, count(*) AS n, min(c) AS low, any_value(nb) AS nb,
        coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM x GROUP BY d, node),
kids AS (SELECT parent, count(*) AS kids FROM v WHERE d > 0 GROUP BY parent),
w AS (SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN kids ON v.node = kids.parent),
s AS (SELECT x.node, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w.nb) AS saved
      FROM w JOIN x ON x.c = w.low AND x.d <= w.d GROUP BY x.node)
SELECT w.low AS conv_id, CAST(w.d AS BIGINT) AS depth, p.low AS parent_conv_id, w.n AS n_convs, w.kids AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON s.node = w.node LEFT JOIN w p ON w.d > 0 AND p.node = w.parent""")
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


#: A share in billionths, smoothed by five occurrences a term.
SQL_SHARE = "1 + CAST((1000000000::HUGEINT * ({n} + 5)) // nullif({total} + 5 * v, 0) AS BIGINT)"


@register("op12_source_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             unnest(regexp_extract_all({SQL_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM d GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS whole FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM d SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {SQL_SHARE.format(n='coalesce(c.n, 0)', total='coalesce(s.size, 0)')} AS p,
           {SQL_SHARE.format(n='k.total', total='l.whole')} AS q
         FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source)
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM cell WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""")
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@register("op13_nearest_neighbours")
def op13_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
