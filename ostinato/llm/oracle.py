"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from . import chosen_path, decontaminate, divergence, ego_join, recompress, resample, sharding, url_filter
from .queries import RULES

_UP, _LOW = url_filter.UPPER, url_filter.LOWER
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _lower(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{_UP}', '{_LOW}')"


def _components(links: str) -> str:
    """Common table comp (id, component_id) of the links (u, v) in both directions."""
    return f"reach(u, v) AS (SELECT u, v FROM {links} UNION SELECT r.u, l.v FROM reach r JOIN {links} l ON r.v = l.u), comp AS (SELECT u AS id, least(u, min(v)) AS component_id FROM reach GROUP BY u)"


def op2() -> str:
    n = recompress.WINDOW
    return f"""WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {n}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - {n - 1}))) AS p FROM dw)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win),
rm AS (SELECT doc_id, list(DISTINCT p + j) AS gone FROM (SELECT doc_id, p, unnest(range({n})) AS j FROM f WHERE r > 1) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), ' ')) AS kept_sha256 FROM dw LEFT JOIN rm ON dw.doc_id = rm.doc_id"""


def op4() -> str:
    digit = lambda k: " || ".join(f"substr('{_BASE32}', CAST((v{k} >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, {', '.join(f"CAST('0x' || substr(sha1(h), {5 * k + 1}, 5) AS BIGINT) AS v{k}" for k in range(8))} FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {' || '.join(digit(k) for k in range(8))} AS payload_digest,
CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to FROM x WINDOW w AS (PARTITION BY h)"""


def op5() -> str:
    order = sorted(RULES, key=lambda r: (-len(r), r))
    fit = lambda r: "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r}'" for r in order) + " END"
    listed = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items()) + " END"
    name = "regexp_replace(host, ':[0-9]*$', '')"
    part = lambda k: f"array_to_string(string_split({name}, '.')[-{k}:], '.')"
    quoted = lambda x: ", ".join(f"'{w}'" for w in x)
    wide = f"(length({part(1)}) = 2 AND split_part({part(2)}, '.', 1) IN ({quoted(url_filter.SECOND_LEVEL)}) OR {part(2)} IN ({quoted(url_filter.SUFFIXES)}))"
    number = f"regexp_matches({name}, '^[0-9.]+$|^\\[')"
    named = f"regexp_matches(translate(host || path, '{_UP}', '{_LOW}'), '(^|[^a-z])({'|'.join(url_filter.BAD_WORDS)})([^a-z]|$)')"
    u = url_filter

    def level(name: str, key: str, up: str, source: str) -> str:
        """Counts, parent's mean, prior strength and posterior mean of a level."""
        return f"""{name}0 AS ({source}),
{name}s AS (SELECT coalesce(greatest({u.WEAKEST}, least({u.STRONGEST}, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {u.STRONGEST} END)), {u.STRONGEST}) AS s FROM (SELECT sum(pow(y - n * m, 2) - n * m * (1 - m)) / CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN sum(n * (n - 1) * m * (1 - m)) END AS rho FROM {name}0)),
{name} AS (SELECT {key}, n, y, s * m + y AS a, s * (1 - m) + n - y AS b FROM {name}0, {name}s)"""

    return f"""WITH h AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {rule} AS rule FROM h), l AS (SELECT *, {listed} AS listed FROM r),
c AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (coalesce(listed = 'block', false) OR {named}) AS DOUBLE) AS y, CASE WHEN {number} THEN {name} WHEN {wide} THEN {part(3)} ELSE {part(2)} END AS domain, CASE WHEN {number} THEN {name} WHEN {wide} THEN {part(2)} ELSE {part(1)} END AS suffix FROM l GROUP BY host),
t AS (SELECT (sum(y) + 0.5) / (sum(n) + 1) AS m FROM c),
{level('su', 'suffix', 't', 'SELECT suffix, sum(n) AS n, sum(y) AS y, any_value(m) AS m FROM c, t GROUP BY suffix')},
{level('dm', 'domain', 'su', 'SELECT c.domain, sum(c.n) AS n, sum(c.y) AS y, any_value(su.a / (su.a + su.b)) AS m FROM c JOIN su USING (suffix) GROUP BY c.domain')},
{level('ho', 'host', 'dm', 'SELECT c.host, c.n, c.y, dm.a / (dm.a + dm.b) AS m FROM c JOIN dm USING (domain)')}
SELECT page_id, l.host, path, rule, coalesce(listed, CASE WHEN a / (a + b) - {u.DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {u.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM l JOIN ho ON l.host = ho.host"""


def op6() -> str:
    return f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
lk AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95), {_components('lk')}, n AS (SELECT u, count(*) AS n_links FROM lk GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM e LEFT JOIN comp ON id = vec_id LEFT JOIN n ON n.u = vec_id"""


def op9() -> str:
    n = decontaminate.WINDOW
    return f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') AS w FROM documents), iw AS (SELECT item_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') AS w FROM benchmark),
wx AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT item_id, w, least(len(w), {n}) AS n, unnest(range(len(w) - least(len(w), {n}) + 1)) AS i FROM iw WHERE len(w) > 0)),
dx AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS p FROM dw, (SELECT DISTINCT n FROM wx))),
hit AS (SELECT doc_id, p, dx.n, item_id FROM dx JOIN wx ON dx.win = wx.win AND dx.n = wx.n),
a AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, p + unnest(range(n)) AS q FROM hit) GROUP BY 1),
b AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN a ON a.doc_id = dw.doc_id LEFT JOIN b ON b.doc_id = dw.doc_id"""


def op10() -> str:
    k, j = chosen_path.SHINGLE, chosen_path.SIMILARITY
    return f"""WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_SPACED}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {k}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {k - 1}))) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
lk AS (SELECT u, v FROM c JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * x >= {j} * (p.n + q.n - x)), {_components('lk')}
SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, dw.doc_id) AS component_id, coalesce(component_id, dw.doc_id) = dw.doc_id AS kept FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN comp ON id = dw.doc_id"""


def _crc32(x: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes: a table by the rule of its polynomial, then byte by byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    octets = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(CAST({table} AS BIGINT[])[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def op11() -> str:
    r = resample
    words = lambda t, k: f"SELECT {k}, unnest(regexp_extract_all({_lower('text')}, '{_ALNUM}')) AS w FROM {t}"
    n = r.BUCKETS
    return f"""WITH dw AS ({words('documents', 'doc_id')}), bw AS ({words('benchmark', 'item_id')}),
v AS (SELECT w, {_crc32('w')} % {n} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, count(*) AS s FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bw JOIN v USING (w) GROUP BY b),
g AS (SELECT v.b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + {n}) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + {n})))) AS BIGINT) AS gain FROM (SELECT DISTINCT b FROM v) v LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
d AS (SELECT doc_id, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{r.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN d USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM y WHERE n_features >= {r.LEAST_FEATURES})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT {r.PERCENT} * count(*) // 100 FROM z) THEN k END AS rank FROM y LEFT JOIN z USING (doc_id)"""


def op12() -> str:
    d = divergence
    p = lambda c, n, v: f"CAST(1 + (CAST(1000000000 AS HUGEINT) * ({c} + {d.PRIOR})) // ({n} + {d.PRIOR} * {v}) AS BIGINT)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lower('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM docs), tw AS (SELECT doc_id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS BIGINT) AS ln FROM tw GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {d.LEAST_DOCS}),
lg AS (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(ln) AS BIGINT) AS lt FROM kept GROUP BY lang),
c AS (SELECT tw.lang, source, tw.term, CAST(count(*) AS BIGINT) AS n FROM tw JOIN kept ON tw.lang = kept.lang AND tw.term = kept.term GROUP BY ALL),
gt AS (SELECT grp.lang, grp.source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM grp LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source GROUP BY ALL),
f AS (SELECT gt.lang, gt.source, kept.term, coalesce(n, 0) AS n, {p('coalesce(n, 0)', 'total', 'v')} AS p, {p('ln', 'lt', 'v')} AS q FROM gt JOIN kept ON kept.lang = gt.lang JOIN lg ON lg.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = kept.term),
dist AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {d.TOP}"""


def op13() -> str:
    k, most = sharding.SHARDS, "(SELECT hi FROM cap)"
    end = lambda place: f"(SELECT max(i) FROM e WHERE s <= {place})"  # noqa: E731  the last boundary not beyond a place
    return f"""WITH RECURSIVE r AS (SELECT doc_id, strlen(coalesce(text, '')) + {sharding.ROW_BYTES} AS size, {_crc32("coalesce(text, '')")} AS text_crc32, md5(coalesce(text, '')) AS d FROM documents),
g AS (SELECT d, row_number() OVER (ORDER BY d) AS i, CAST(sum(sum(size)) OVER (ORDER BY d) AS BIGINT) AS s FROM r GROUP BY d), e AS (SELECT 0 AS i, 0 AS s UNION ALL SELECT i, s FROM g),
n AS (SELECT max(i) AS n, max(s) AS total FROM e),
b(lo, hi, step, i, s) AS (SELECT CAST(ceil(total / {k}) AS BIGINT), total, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM n UNION ALL
SELECT CASE WHEN step = {k} AND s < total THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN step = {k} AND s >= total THEN (lo + hi) // 2 ELSE hi END, CASE WHEN step = {k} THEN 0 ELSE step + 1 END, CASE WHEN step = {k} THEN 0 ELSE {end('b.s + (lo + hi) // 2')} END, CASE WHEN step = {k} THEN 0 ELSE (SELECT max(s) FROM e WHERE s <= b.s + (lo + hi) // 2) END FROM b, n WHERE lo < hi),
cap AS (SELECT min(hi) AS hi FROM b),
late(m, i, s) AS (SELECT 0, n, total FROM n UNION ALL SELECT m + 1, (SELECT min(i) FROM e WHERE s >= late.s - {most}), (SELECT min(s) FROM e WHERE s >= late.s - {most}) FROM late WHERE m < {k}),
cut(m, i, s) AS (SELECT {k}, CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT z.m - 1, z.j, (SELECT s FROM e WHERE e.i = z.j) FROM (SELECT y.m, greatest(y.i, least({end(f'y.s + {most}')}, greatest((SELECT min(i) FROM late WHERE late.m = y.m - 1), (SELECT e.i FROM e ORDER BY abs(y.m * (e.s - y.s) - (n.total - y.s)), e.i LIMIT 1)))) AS j FROM cut y, n WHERE y.m > 0) z),
x AS (SELECT doc_id, size, text_crc32, r.d, CAST((SELECT count(*) FROM cut WHERE cut.m BETWEEN 1 AND {k - 1} AND cut.i < g.i) AS INTEGER) AS shard FROM r JOIN g ON r.d = g.d)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY d, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM x"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": op2(), "op4_warc": op4(), "op5_url_filter": op5(), "op6_embedding_dedup": op6(), "op9_decontamination": op9(), "op10_minhash_dedup": op10(), "op11_importance_resampling": op11(), "op12_source_divergence": op12(), "op13_sharding": op13()}
