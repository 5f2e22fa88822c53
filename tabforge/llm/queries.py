"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.block_naming import exact_duplicates
from tabforge.llm.common import table
from tabforge.llm.cross_polytope import nearest
from tabforge.llm.infilling import fill_in_middle, restore
from tabforge.llm.mixing import taken_words
from tabforge.llm.piece_bpe import encode_documents, with_digests
from tabforge.llm.quotes import reply_order
from tabforge.llm.repeat_intervals import remove_repeats
from tabforge.llm.resampling import importance_sample
from tabforge.llm.rlz_spans import parse
from tabforge.llm.source_audit import audit_sources
from tabforge.llm.simhash_bk import hex_fingerprint, near_duplicates
from tabforge.llm.warc_zstd import archived
from tabforge.llm.weak_supervision import is_held_out, score_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_block_naming", f"""
WITH d AS (SELECT doc_id, {LOWER_SQL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""")
def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op1_slot_schedule", """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
           FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS src FROM t),
w AS (SELECT *, [5.0, 2.0, 1.0][(src % 3 + 1)::INT]::DOUBLE AS w, source_size * 3 AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, src
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT arg_min(level, struct_pack(a := cap / w, b := src)) AS common FROM l WHERE cap > level * w),
s AS (SELECT source, src, source_size,
             round(CASE WHEN common IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, common * w) END, 6) AS target
      FROM l, c),
e AS (SELECT d.doc_id, d.size, s.src, s.target, x.epoch,
             ('0x' || substr(md5('7|' || x.epoch || CASE WHEN doc_id IS NULL THEN '' ELSE '|' || doc_id END), 1, 15))::BIGINT AS o
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, (SELECT unnest([0, 1, 2]) AS epoch) x),
p AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY epoch, o, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos FROM e),
k AS (SELECT doc_id, sum(greatest(0, least(pos + size, round(target)) - pos))::BIGINT AS taken FROM p GROUP BY doc_id)
SELECT d.doc_id, d.size, s.source_size, s.target, k.taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN k ON d.doc_id = k.doc_id
""")
def op1_slot_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def model_path() -> str:
    """The public 32k BPE model installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_prefix_table")
def op7_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = with_digests(encode_documents(table(spark, sf_dir, "documents"), model_path()))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_weak_supervision")
def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_bk_tree")
def op6_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, radius=3)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_rlz_parse", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM g),
m AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN m USING (win) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, count(r.p) AS n_removed, string_agg(CASE WHEN r.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept
      FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""")
def op3_rlz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


@query("op8_interval_tree", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte,
             CASE WHEN i + 100 <= length(h) // 2 THEN substr(h, 2 * i + 1, 200) END AS win FROM b),
f AS (SELECT doc_id, i, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT doc_id, i, byte, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
      FROM f),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
k AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count_if(gone = 1 AND before = 0) AS n_spans,
             string_agg(CASE WHEN gone = 0 THEN byte END, '' ORDER BY i) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""")
def op8_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_cross_polytope")
def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_importance_resampling")
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw: all documents. Target: those labelled good, a fifth of the labels held out."""
    docs = table(spark, sf_dir, "documents")
    good = (table(spark, sf_dir, "labels").filter("quality = 1").filter(~is_held_out(F.col("doc_id")))
            .select("doc_id").distinct())
    # dealt by id at every size: the labels grow with the documents
    return importance_sample(docs, docs.join(good.hint("merge"), "doc_id"), keep=0.85)


# Quote levels, passages and the units they can come from, line by line; then
# parents (recursively, for the depth) and places by turn.
QUOTES_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS i FROM m WHERE contains(text, '>')),
v AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level,
             regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') AS body FROM l),
n AS (SELECT *, lead(level, 1, 0) OVER w AS after, lag(level, 1, 0) OVER w AS before FROM v WINDOW w AS (PARTITION BY rid ORDER BY i)),
o AS (SELECT rid, max(level) AS top, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (
        after > 0 AND regexp_matches(body, '^.*\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$'))), ''), chr(10)) AS own
      FROM n GROUP BY rid),
t AS (SELECT m.rid, conv_id, turn, role, CASE WHEN top > 0 THEN own ELSE text END AS text FROM m LEFT JOIN o USING (rid)),
g AS (SELECT *, sum((level <> before)::INT) OVER (PARTITION BY rid ORDER BY i) AS grp FROM n),
p AS (SELECT rid, conv_id, turn, grp, max(level) AS level, string_agg(body, ' ' ORDER BY i) AS whole,
             arg_max(body, length(trim(regexp_replace(body, '\s+', ' ', 'g'))) * 100000 - i) AS longest
      FROM g WHERE level > 0 GROUP BY rid, conv_id, turn, grp),
u AS (SELECT rid, conv_id, turn, text AS unit FROM t UNION ALL
      SELECT rid, conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) FROM t UNION ALL
      SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) FROM t),
un AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(unit, '\s+', ' ', 'g'))) AS k FROM u),
a AS (SELECT rid, conv_id, turn, grp, level, 0 AS nth, lower(trim(regexp_replace(whole, '\s+', ' ', 'g'))) AS k FROM p UNION ALL
      SELECT rid, conv_id, turn, grp, level, 1, lower(trim(regexp_replace(longest, '\s+', ' ', 'g'))) FROM p),
held AS (SELECT conv_id, k, min(turn) AS turn FROM un WHERE k <> '' GROUP BY conv_id, k),
f AS (SELECT a.*, h.conv_id AS o_conv, h.turn AS o_turn,
             CASE WHEN h.conv_id IS NOT DISTINCT FROM a.conv_id THEN 0 ELSE 1 END AS far
      FROM a JOIN held h USING (k) WHERE (h.conv_id IS NOT DISTINCT FROM a.conv_id AND (h.turn < a.turn OR a.turn IS NULL AND h.turn IS NOT NULL))
         OR (h.conv_id IS DISTINCT FROM a.conv_id AND NOT EXISTS (SELECT 1 FROM held e WHERE e.k = a.k
             AND (e.conv_id < h.conv_id OR (e.conv_id IS NULL AND h.conv_id IS NOT NULL))))),
links AS (SELECT conv_id, turn, rid, grp, max(level) AS level, arg_min(o_conv, far * 10 + nth) AS o_conv,
                 arg_min(o_turn, far * 10 + nth) AS o_turn, min(far) AS far FROM f GROUP BY conv_id, turn, rid, grp),
node AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST) - 1 AS position
         FROM (SELECT DISTINCT conv_id, turn FROM m)),
reply AS (SELECT conv_id, turn, max(o_turn) AS reply FROM links WHERE level = 1 AND far = 0 GROUP BY conv_id, turn),
parent AS (SELECT node.conv_id, node.turn, node.position, CASE WHEN node.position > 0 THEN coalesce(q.position, node.position - 1) END AS up
           FROM node LEFT JOIN reply r ON r.conv_id IS NOT DISTINCT FROM node.conv_id AND r.turn IS NOT DISTINCT FROM node.turn
           LEFT JOIN node q ON q.conv_id IS NOT DISTINCT FROM node.conv_id AND q.turn = r.reply),
depth AS (SELECT conv_id, position, 0 AS depth FROM parent WHERE up IS NULL UNION ALL
          SELECT c.conv_id, c.position, d.depth + 1 FROM parent c JOIN depth d
          ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.up = d.position),
linked AS (SELECT conv_id, turn, count(*) AS n_linked FROM links GROUP BY conv_id, turn),
quoted AS (SELECT rid, count(*) AS n_quotes FROM p GROUP BY rid)
SELECT t.conv_id, t.turn, t.role, x.position, y.turn AS reply_to, d.depth::BIGINT AS depth,
       coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, t.text
FROM t JOIN parent x ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND x.turn IS NOT DISTINCT FROM t.turn
JOIN depth d ON d.conv_id IS NOT DISTINCT FROM x.conv_id AND d.position = x.position
LEFT JOIN parent y ON y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.position = x.up
LEFT JOIN linked k ON k.conv_id IS NOT DISTINCT FROM t.conv_id AND k.turn IS NOT DISTINCT FROM t.turn
LEFT JOIN quoted q ON q.rid = t.rid
"""


@query("op2_quotation_linking", QUOTES_SQL)
def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


# Exact integers throughout: hugeint where a product may pass 64 bits.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
           FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
w AS (SELECT rid, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
gt AS (SELECT g.lang, g.source, coalesce(sum(n) FILTER (k.term IS NOT NULL), 0)::HUGEINT AS total
       FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (lang_total + 2 * v) AS q
      FROM gt g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""


@query("op13_length_buckets", AUDIT_SQL)
def op13_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


# SHA-1 as base32: eight groups of five hex digits, four letters each.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, upper(sha1(t)) AS h, first_value(page_id) OVER w AS f, row_number() OVER w AS k
      FROM p WINDOW w AS (PARTITION BY t ORDER BY page_id NULLS LAST)),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS g FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((g[i // 4 + 1] >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM b
"""


@query("op11_zstd_archive", WARC_SQL)
def op11_zstd_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
x AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
s AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
             array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


@query("op12_chunk_infilling", FIM_SQL)
def op12_chunk_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
