"""DuckDB SQL for the registered corpus queries that SQL can express.

Written over plain lists and joins, without the operators' methods.  Not
expressible: XXH64 fingerprints (SimHash), keyed surrogates, best-fit packing
and differencing; tests/llm checks those against brute force.
"""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UP}', '{_LOW}')"


def _alnum(text: str) -> str:
    return f"regexp_extract_all({_lower(text)}, '{_ALNUM}')"


_URL = f"""
WITH p AS (SELECT page_id, {_lower(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS rn
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND rn = 1
"""

_DECON = f"""
WITH d AS (SELECT doc_id, {_alnum('text')} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS l FROM (SELECT item_id, {_alnum('text')} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM b, unnest(range(1, len(w) - l + 2)) AS t(i)),
lens AS (SELECT DISTINCT l FROM b),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s FROM d, lens, unnest(range(1, len(w) - l + 2)) AS t(i)),
hits AS (SELECT doc_id, l, i, s FROM dw WHERE s IN (SELECT s FROM bw)),
nh AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, l)) AS u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN bw USING (s)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_LEDGER = f"""
t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_PLAIN}')) AS lines FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, unnest(range(0, 3)) AS v(j) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM t LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
               + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
               + 32 * (word_chars > 20 * n_words)::INT + 64 * (2 * n_upper > word_chars)::INT AS BIGINT) AS fail_bits FROM m)
"""

_QUALITY = f"""
WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_upper, fail_bits
FROM f
"""

_ABLATION = f"""
WITH {_LEDGER},
pol(policy, version, mask, least_n) AS (VALUES ('base', 1, 3), ('strict', 1, 15), ('strict', 2, 127), ('lenient', 1, 127)),
rul(bit, rule) AS (VALUES (0, 'few_words'), (1, 'repeated_words'), (2, 'symbols'), (3, 'repeated_lines'), (4, 'short_words'),
                          (5, 'long_words'), (6, 'upper_case')),
p AS (SELECT policy, version, mask, CASE policy WHEN 'lenient' THEN 2 ELSE 1 END AS need, rule, CAST(1 << bit AS BIGINT) AS b
      FROM pol, rul WHERE (mask & (1 << bit)) <> 0)
SELECT policy, CAST(version AS INT) AS version, rule, CAST(sum(((fail_bits & b) <> 0)::INT) AS BIGINT) AS n_fail,
       CAST(sum((bit_count(fail_bits & mask) >= need)::INT) AS BIGINT) AS n_rejected,
       CAST(sum((bit_count(fail_bits & mask) >= need
                 AND bit_count(fail_bits & mask) - ((fail_bits & b) <> 0)::INT < need)::INT) AS BIGINT) AS n_kept_without
FROM f, p GROUP BY policy, version, rule
""".replace("pol(policy, version, mask, least_n)", "pol(policy, version, mask)")

_B32 = " || ".join(f"to_base(CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT), 32, 4)" for i in range(8))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, translate({_B32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV',
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, min(page_id) OVER (PARTITION BY html) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN low <> page_id THEN low END AS refers_to, true AS complete
FROM q
"""

_CHAT = """
WITH c AS (SELECT conv_id, list(coalesce(role, '') || chr(1) || coalesce(text, '') ORDER BY turn) AS ts FROM conversations GROUP BY conv_id),
pre AS (SELECT DISTINCT ts[1:i] AS p FROM c, unnest(range(1, len(ts))) AS t(i)),
keep AS (SELECT min(conv_id) AS conv_id FROM c WHERE ts NOT IN (SELECT p FROM pre) GROUP BY ts)
SELECT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS part, CAST(count(*) AS INT) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10),
                  '' ORDER BY turn) AS text
FROM conversations WHERE conv_id IN (SELECT conv_id FROM keep) GROUP BY 1, 2
"""


def _license_sql() -> str:
    from meterline.llm.license_scan import PHRASES, TEMPLATES
    places = []
    for phrase, label in PHRASES:
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {same}), lambda i: "
                      f"{{'at': i - 1, 'label': '{label}'}})")
    values = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_alnum('text')} AS w FROM documents),
pl AS (SELECT doc_id, list_concat({', '.join(places)}) AS hits FROM d),
pb AS (SELECT doc_id, count(*) AS n_base, min(x.at) AS first_word, max(x.at) AS last_word,
              string_agg(DISTINCT x.label, ',' ORDER BY x.label) AS base_labels, list(DISTINCT x.label) AS bl
       FROM pl, unnest(hits) AS u(x) GROUP BY doc_id),
n(label, notice) AS (VALUES {values}),
ts AS (SELECT label, list_distinct({_alnum('notice')}) AS tw FROM n),
bk AS (SELECT DISTINCT doc_id, list_distinct({_alnum('line')}) AS bw FROM d, unnest(string_split(text, chr(10))) AS u(line)),
mt AS (SELECT doc_id, label, len(list_intersect(tw, bw)) AS c, len(tw) AS s FROM bk, ts
       WHERE len(list_intersect(tw, bw)) >= ceil(0.8 * len(tw) - 1e-9)),
ml AS (SELECT doc_id, list(DISTINCT label) AS ll, max(c * 1.0 / s) AS score FROM mt GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ll, [])))), ',') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN pb USING (doc_id) LEFT JOIN ml USING (doc_id)
"""


_COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
      FROM w, unnest(range(1, 5)) AS a(m), unnest(range(1, len(w) - m + 2)) AS b(i) GROUP BY ALL HAVING f >= 30),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m >= 2),
cut AS (SELECT c.lang, c.phrase, c.w, a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
        FROM c, unnest(range(1, m)) AS u(k) JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
        JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
        FROM c, unnest(range(2, m)) AS x(s), unnest(range(1, m - s + 2)) AS y(i) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM rk JOIN t USING (lang) WHERE rank <= 2000
"""


def _manifest_sql(levels: int = 13) -> str:
    """One CTE a level; ``levels`` is enough for 3 ** levels rows of a source."""
    def tree(name: str, table: str, group: str, order: str) -> str:
        # id: the leaf's place; h0: its digest; each level adds the node's hash and the siblings before and after
        sql = [f"{name}0 AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS p, "
               f"count(*) OVER (PARTITION BY {group}) AS n, '' AS proof, [] AS steps, h AS node FROM {table})"]
        for i in range(levels):
            sql.append(f"""{name}n{i} AS (SELECT {group} AS g, p // 3 AS q, string_agg(node, '' ORDER BY p) AS kids
              FROM (SELECT DISTINCT {group}, p, node FROM {name}{i}) GROUP BY 1, 2),
{name}{i + 1} AS (SELECT x.* REPLACE (p // 3 AS p, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(kids) ELSE node END AS node,
              CASE WHEN n > 1 THEN proof || substr(kids, 1, 64 * (p % 3)) || substr(kids, 64 * (p % 3) + 65) ELSE proof END AS proof,
              CASE WHEN n > 1 THEN list_append(steps, [substr(kids, 1, 64 * (p % 3)), substr(kids, 64 * (p % 3) + 65)]) ELSE steps END AS steps)
              FROM {name}{i} x JOIN {name}n{i} k ON k.g IS NOT DISTINCT FROM x.{group} AND k.q = x.p // 3)""")
        return ",\n".join(sql)

    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in
                  ("CAST(doc_id AS VARCHAR)", "CAST(source AS VARCHAR)", "CAST(lang AS VARCHAR)", "CAST(n_chars AS VARCHAR)", text)]
        return f"sha256({' || '.join(fields)})"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))"
    crc = (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), "
           "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)")
    fold = "list_reduce(list_concat([[{0}, '']], steps), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1]"
    return f"""
WITH l AS (SELECT doc_id, source, {leaf('text')} AS h,
      CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS t FROM documents),
{tree('a', 'l', 'source', 'doc_id NULLS FIRST, h')},
s AS (SELECT DISTINCT source, node AS h, 1 AS one FROM a{levels}),
{tree('b', 's', 'one', 'source NULLS FIRST')},
j AS (SELECT doc_id, a.h AS leaf, a.t, a.node AS subroot, b.node AS root, a.proof || b.proof AS proof, list_concat(a.steps, b.steps) AS steps
      FROM a{levels} a JOIN b{levels} b ON a.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, {fold.format('t')} AS folded_root, {fold.format('t')} = root AS verified
FROM j
"""


ORACLE: dict[str, str] = {
    "op1_url_filters": _URL,
    "op3_decontamination": _DECON,
    "op4_quality_rules": _QUALITY,
    "op5_warc": _WARC,
    "op7_chat": _CHAT,
    "op10_license_scan": _license_sql(),
    "quality_ablation": _ABLATION,
    "op11_collocations": _COLLOCATIONS,
    "op13_manifest": _manifest_sql(),
}
