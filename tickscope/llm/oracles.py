"""DuckDB SQL for the queries that SQL can express, written from the definitions, not from the Spark plans."""

from __future__ import annotations

#: Words of a text as a list.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# The polynomial of crc32, reflected.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, {bytes}),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"""


def _crc(text: str) -> str:
    """crc32 of an SQL string expression."""
    byte = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::UBIGINT)"
    return f"xor({_CRC.format(bytes=byte)}, 4294967295::UBIGINT)::BIGINT"


_HASH = "md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')))"

SHARDING = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_HASH.format(seed='shard')} AS u FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u) AS rk, count(*) OVER (PARTITION BY source) AS n FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY (2 * rk - 1) / (2 * n)::DOUBLE, u) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, (place * 24) // total AS shard FROM o),
codes AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS code)
SELECT doc_id, (strlen(t) + 8)::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::UBIGINT)),
                       lambda c, b: xor(c >> 8, code[(xor(c, b) & 255)::INTEGER + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
       'rows' AS law, shard::INTEGER AS shard, (place - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s, codes
"""

DECONTAMINATION = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM iw),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM dw),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1),
p AS (SELECT doc_id, item_id, count(*) AS shared FROM ig JOIN dg USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, shared / n::DOUBLE AS containment FROM p JOIN n USING (item_id) WHERE shared >= 0.8 * n - 1e-9
"""

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM win),
low AS (SELECT h, min(doc_id) AS low FROM h GROUP BY h),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN low USING (h) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN bad USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

EMBEDDING = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

LINES = r"""
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, coalesce('s' || source, 'n') AS site, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM parts),
bad AS (SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT site) >= 5),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS text FROM lines ANTI JOIN bad USING (line) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM parts d LEFT JOIN kept USING (doc_id)
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, {_HASH.format(seed='mix')} AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, words * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(words) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER earlier, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER earlier, 0)) AS level
      FROM w WINDOW earlier AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, cap / w) AS water FROM l WHERE level <= cap / w),
t AS (SELECT source, words, least(cap, coalesce(water, 1e300) * w) AS target FROM l LEFT JOIN water ON true),
r AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END::INTEGER AS whole FROM t),
q AS (SELECT d.*, words, target, whole, target - whole * words AS wanted, (('0x' || substr(u, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS x,
      greatest(size, 1)::BIGINT AS big, greatest(length(bin(greatest(size, 1))) - 5, 0)::INTEGER AS low
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
m AS (SELECT *, ((big >> low) << low)::BIGINT AS measure FROM q),
-- the level of each measure if all larger ones are certain; the largest whose inclusion is then below 1 is right
classes AS (SELECT source, measure, any_value(wanted) AS wanted, sum(size) AS own, sum(size::HUGEINT * measure) AS mass FROM m WHERE size > 0 AND wanted > 0 GROUP BY source, measure),
levels AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
           (sum(mass) OVER (PARTITION BY source ORDER BY measure ROWS UNBOUNDED PRECEDING))::DOUBLE AS below FROM classes),
sc AS (SELECT source, max(measure) AS top, arg_max((wanted - sure) / below, measure) AS scale, arg_max(sure, measure) AS sure FROM levels WHERE (wanted - sure) / below * measure < 1 GROUP BY source),
p AS (SELECT m.*, top, sure, greatest(least(scale * measure, 1 - 1e-12), 1e-12) AS p FROM m LEFT JOIN sc ON m.source IS NOT DISTINCT FROM sc.source),
o AS (SELECT *, x / (1 - x) / (p / (1 - p)) AS rank FROM p),
c AS (SELECT *, sum(size) OVER (PARTITION BY source, measure > top ORDER BY rank, u ROWS UNBOUNDED PRECEDING) AS until FROM o),
k AS (SELECT *, whole + CASE WHEN measure > top OR until - size / 2.0::DOUBLE <= wanted - sure THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size::BIGINT AS size, words AS source_size, target, (size * copies)::BIGINT AS taken, copies::INTEGER AS copies FROM k
"""

LM = rf"""
WITH digits AS (SELECT doc_id, coalesce(text, '') AS text, {_crc("doc_id::VARCHAR")} % 5 = 1 AS held_out FROM documents),
d AS (SELECT doc_id, held_out, list_append({_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ' ') AS t FROM digits),
tok AS (SELECT doc_id, held_out, unnest(list_concat([NULL, chr(10)], t[:-3])[:len(t)]) AS before, unnest(list_prepend(chr(10), t[:-2])) AS prev, unnest(t) AS w FROM d),
c1 AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
c2 AS (SELECT prev, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY prev, w),
c3 AS (SELECT before, prev, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY before, prev, w),
e2 AS (SELECT prev, count(*) AS c FROM tok WHERE NOT held_out GROUP BY prev),
e3 AS (SELECT before, prev, count(*) AS c FROM tok WHERE NOT held_out GROUP BY before, prev),
nv AS (SELECT sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v FROM c1),
-- a text's first token has one token of history, the edge, so its join with the third order finds nothing
x AS (SELECT doc_id, held_out, coalesce(c1.c, 0) AS c, coalesce(c3.c, 0) AS c3, coalesce(e3.c, 0) AS ce3, n,
             (coalesce(c1.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p, (coalesce(c2.c, 0) + 8 * p) / (coalesce(e2.c, 0) + 8) AS p2
      FROM tok LEFT JOIN c1 USING (w) LEFT JOIN c2 USING (prev, w) LEFT JOIN c3 USING (before, prev, w) LEFT JOIN e2 USING (prev) LEFT JOIN e3 USING (before, prev) CROSS JOIN nv)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n)::BIGINT AS train_tokens,
       round(fsum(log10(p)), 5) AS base_score, round(fsum(log10((c3 + 8 * p2) / (ce3 + 8))), 5) AS score
FROM x GROUP BY doc_id
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

MERKLE = f"""
WITH RECURSIVE d AS (SELECT *, {_crc("doc_id::VARCHAR")} % 2 = 0 AS tampered FROM documents),
h AS (SELECT doc_id, source, {_LEAF.format(text='text')} AS leaf, CASE WHEN tampered THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text='text')} END AS claim FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
up AS (SELECT source, 0 AS level, pos, n, leaf AS hash FROM leaves
       UNION ALL SELECT source, level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, level, pos // 3),
tops AS (SELECT source, hash AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS sources FROM up WHERE n = 1),
over AS (SELECT 0 AS level, place AS pos, sources AS n, subroot AS hash FROM tops
         UNION ALL SELECT level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT hash AS root FROM over WHERE n = 1),
-- one numbering of the levels of both trees of a leaf: those of its group, then those over the groups
near AS (SELECT source, level, pos, hash FROM up WHERE n > 1 UNION ALL SELECT source, height + over.level, over.pos, hash FROM over, tops WHERE n > 1 AND over.pos // 3 = (place // pow(3, over.level)::BIGINT) // 3),
runs AS (SELECT source, level, pos // 3 AS run, list(hash ORDER BY pos) AS hashes FROM near GROUP BY ALL),
ends AS (SELECT source, max(level) + 1 AS levels FROM runs GROUP BY source),
climb AS (SELECT doc_id, source, leaf, pos AS first, 0 AS level, pos, claim AS folded, '' AS proof FROM leaves
          UNION ALL
          SELECT doc_id, c.source, leaf, first, c.level + 1, p // 3, sha256(array_to_string(hashes[1:p % 3], '') || folded || array_to_string(hashes[p % 3 + 2:], '')),
                 proof || array_to_string(hashes[1:p % 3], '') || array_to_string(hashes[p % 3 + 2:], '')
          FROM (SELECT c.*, CASE WHEN c.level = height THEN place ELSE c.pos END AS p FROM climb c JOIN tops ON c.source IS NOT DISTINCT FROM tops.source) c
          JOIN runs ON c.source IS NOT DISTINCT FROM runs.source AND c.level = runs.level AND p // 3 = run)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb JOIN tops ON climb.source IS NOT DISTINCT FROM tops.source CROSS JOIN root LEFT JOIN ends ON climb.source IS NOT DISTINCT FROM ends.source
WHERE climb.level = coalesce(levels, 0)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, min(page_id) AS low, count(*) AS n FROM p GROUP BY h)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       -- five hex digits are four of base 32
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 5 * i::INTEGER + 1, 5))::INTEGER >> k) % 32 + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM low AND low IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM p JOIN m USING (h)
"""

SPELLING = r"""
WITH RECURSIVE codes AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS code),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::UBIGINT)),
                                          lambda c, b: xor(c >> 8, code[(xor(c, b) & 255)::INTEGER + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM per, codes),
told AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
lex AS (SELECT word, sum(n)::BIGINT AS n FROM told GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM lex)),
near AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT cut.word, lex.word FROM cut JOIN lex ON rest = lex.word UNION SELECT lex.word, cut.word FROM cut JOIN lex ON rest = lex.word),
ranked AS (SELECT x, y, n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY n DESC, encode(y)) AS place FROM near JOIN lex ON y = lex.word),
forms AS (SELECT lex.word, lex.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * lex.n THEN y END AS form, CASE WHEN r.n >= 5 * lex.n THEN r.n END AS form_n FROM lex LEFT JOIN ranked r ON x = word AND place = 1),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON root = forms.word WHERE form IS NOT NULL)
SELECT word, forms.form, root, n, n_near, form_n FROM forms JOIN (SELECT chain.word, root FROM chain JOIN forms f ON root = f.word WHERE f.form IS NULL) USING (word)
"""

ORACLES = {"op1_sharding": SHARDING, "op3_decontamination": DECONTAMINATION, "op4_substring": SUBSTRING, "op5_embedding": EMBEDDING,
           "op6_lines": LINES, "op8_lm": LM, "op10_mixing": MIXING, "op11_merkle": MERKLE, "op12_warc": WARC, "op13_spelling": SPELLING}
