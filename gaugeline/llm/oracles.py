"""DuckDB SQL of the operators whose rows SQL can give on whole tables."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang,
                  unnest(regexp_split_to_array({_LOW.format("COALESCE(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT lang, ws, i, unnest([1, 2, 3, 4]) AS size FROM i),
f AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, CAST(COUNT(*) AS HUGEINT) AS a
      FROM k WHERE i + size - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, SUM(a) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size >= 2 AND a >= 30),
ct AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS cut FROM c),
s AS (SELECT ct.lang, ct.phrase, ct.size, ct.a, cut, x.a AS l, y.a AS r, (2000000 * ct.a) // (x.a + y.a) AS score
      FROM ct JOIN f x ON x.lang = ct.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
              JOIN f y ON y.lang = ct.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (
        SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')
        AND 100 * c.a >= 80 * b.a)),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT t.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""

OP13 = f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {_LOW.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING COUNT(DISTINCT r) >= 10)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(f.key) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY r, doc_id"""

# crc32 byte by byte from its 256-entry table; runs hold code points of one or
# two UTF-8 bytes only.  Two words are near if they are equal without the code point
# at one place, or one of them without a code point is the other.
OP12 = f"""
WITH RECURSIVE tb AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
m AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id,
             unnest(regexp_extract_all({_LOW.format("COALESCE(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT id, w, COUNT(*) AS n, id || ':' || w AS s FROM m GROUP BY ALL),
b AS (SELECT w, n, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)]
                                          ELSE [195, unicode(x) - 64] END)) AS bytes FROM g),
h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], bytes),
             lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tb),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substring(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word,
             CAST(SUM(n) AS BIGINT) AS n FROM h GROUP BY 1),
k AS (SELECT * FROM v WHERE length(word) >= 5 AND n >= 3),
x AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM k)),
pr AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
       UNION SELECT x.word, k.word FROM x JOIN k ON x.rest = k.word
       UNION SELECT k.word, x.word FROM x JOIN k ON x.rest = k.word),
nr AS (SELECT pr.a AS word, pr.b AS near, k.n AS near_n FROM pr JOIN k ON k.word = pr.b),
st AS (SELECT word, COUNT(*) AS n_near FROM nr GROUP BY word),
fm AS (SELECT nr.word, near AS form, near_n AS form_n FROM nr JOIN k ON k.word = nr.word WHERE near_n >= 2 * k.n
       QUALIFY ROW_NUMBER() OVER (PARTITION BY nr.word ORDER BY near_n DESC, near) = 1),
wk AS (SELECT word, form AS up, 1 AS d FROM fm UNION ALL SELECT wk.word, fm.form, d + 1 FROM wk JOIN fm ON fm.word = wk.up),
rt AS (SELECT word, ARG_MAX(up, d) AS root FROM wk GROUP BY word)
SELECT k.word, fm.form, COALESCE(rt.root, k.word) AS root, k.n, COALESCE(st.n_near, 0) AS n_near, fm.form_n
FROM k LEFT JOIN st ON st.word = k.word LEFT JOIN fm ON fm.word = k.word LEFT JOIN rt ON rt.word = k.word"""
