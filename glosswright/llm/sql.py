"""DuckDB SQL for the queries of this subpackage that SQL can express; written apart from the operators, so that it checks them."""

from __future__ import annotations

from glosswright.llm import licenses, urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS, _SPACE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UP}', '{_LOW}')"


def op1_decontamination(window: int = 10) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("text")}, '{_LETTERS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low("text")}, '{_LETTERS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least({window}, len(w)) - 1], ' ') AS win, least({window}, len(w)) AS n
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT r, i, spots.n, item_id FROM spots JOIN wins ON wins.n = spots.n AND wins.win = array_to_string(w[i:i + spots.n - 1], ' ')),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def op2_url_filter() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    return f"""
WITH rules(site, start, says) AS (VALUES {rules}),
parts AS (SELECT row_number() OVER () AS r, page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host,
                 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
                 lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS asked FROM pages),
sites AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), CASE WHEN regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]:') THEN ':443$' ELSE ':80$' END, ''), '^www\\.', '') AS site FROM parts),
canon AS (SELECT *, CASE WHEN contains(url, '://') THEN site || regexp_replace(path, '/+$', '') || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS c FROM sites),
listed AS (SELECT c FROM canon WHERE c IS NOT NULL GROUP BY c HAVING count(*) > 1),
fits AS (SELECT r, arg_max(site || start, length(site || start)) AS rule, arg_max(says, length(site || start)) AS says
         FROM parts JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY r)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN says WHEN listed.c IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM canon LEFT JOIN fits USING (r) LEFT JOIN listed USING (c)"""


def op3_substring_dedup(window: int = 13) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
spots AS (SELECT r, id, i, sha256(array_to_string(w[i:i + {window - 1}], ' ')) AS win FROM (SELECT r, id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
least_id AS (SELECT win, min(id) AS least FROM spots GROUP BY win HAVING min(id) < max(id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS p FROM spots JOIN least_id USING (win) WHERE id > least),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def op5_jaccard_join(shingle: int = 5, percent: int = 75) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("text")}, '{_SPACE}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + least({shingle}, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - least({shingle}, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(e.doc_id) AS component_id FROM reach JOIN d ON reach.a = d.r JOIN d e ON reach.b = e.r LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id"""


def op6_warc(least: int = 100) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= {least} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {least} AND page_id <> first THEN first END AS refers_to FROM f"""


def op8_mixing(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> str:
    """The level of targets is that of the sources which aren't held at their caps: with sources by cap / weight, the first at which the rest gets no more than their caps."""
    weight = f"CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {' '.join(f'WHEN {i} THEN {float(w)}::DOUBLE' for i, w in enumerate(weights))} END"
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACE}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':{seed}') AS key FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, {weight} AS weight, {most}::DOUBLE * source_size AS cap FROM sums),
held AS (SELECT *, coalesce(sum(cap) OVER w, 0)::DOUBLE AS below, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open FROM weighed
         WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT arg_min(((SELECT {share}::DOUBLE * sum(source_size) FROM sums) - below) / open, cap / weight) AS level FROM held
           WHERE ((SELECT {share}::DOUBLE * sum(source_size) FROM sums) - below) / open <= cap / weight),
targets AS (SELECT source, source_size, least(cap, (SELECT level FROM levels) * weight) AS target FROM weighed),
placed AS (SELECT doc_id, size, source_size, target, floor(target + 1e-6)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 1e-6)::BIGINT // source_size ELSE 0 END AS epochs,
                  sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
           FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM placed"""


#: Patterns of secrets in their order, the least length of a match, and for ``assign`` the part that counts.
_SECRETS = (
    ("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"\']?\x20*[:=]\x20*[\"\']?[A-Za-z0-9+/_.=-]+", 6),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]+", 24),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    ("awstemp", "ASIA[A-Z0-9]+", 20),
    ("stripe", "[sr]k_live_[A-Za-z0-9]+", 32),
    ("npm", "npm_[A-Za-z0-9]+", 40),
    ("hub", "hf_[A-Za-z0-9]+", 37),
    ("cloud", "dop_v1_[0-9a-f]+", 71),
    ("shop", "shp(?:at|ca|pa|ss)_[0-9a-f]+", 38),
    ("hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]+", 45),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\\\s\"',:.]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----)?", 0),
)

#: Those that begin where no letter, digit, "-" or "_" stands before; the byte before is part of the match here.
_BOUNDED_SECRETS = (
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    ("google", "AIza[A-Za-z0-9_-]+", 39),
    ("gitlab", "glpat-[A-Za-z0-9_-]+", 26),
    ("githubpat", "github_pat_[A-Za-z0-9_]+", 50),
    ("sk", "sk-[A-Za-z0-9_-]+", 40),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
    ("twilio", "(?:AC|SK)[0-9a-f]+", 34),
    ("urluser", r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+-]+@", 0),
    ("pypi", "pypi-[A-Za-z0-9_-]+", 60),
    ("slackapp", "xapp-[A-Za-z0-9-]+", 30),
    ("square", "sq0(?:atp|csp)-[A-Za-z0-9_-]+", 29),
    ("databricks", "dapi[0-9a-f]+", 36),
    ("mailgun", "key-[0-9a-f]+", 36),
    ("telegram", "[0-9]+:AA[A-Za-z0-9_-]+", 43),
    ("oauth", r"ya29\.[A-Za-z0-9_-]+", 30),
    ("vault", r"hvs\.[A-Za-z0-9_-]+", 28),
    ("linear", "lin_api_[A-Za-z0-9]+", 48),
    ("age", "AGE-SECRET-KEY-1[A-Z0-9]+", 70),
)


def op9_secret_scan() -> str:
    """A match begins after the lengths of all matches and of the pieces between them that come before it, and after the byte before it that it may hold."""
    rules = (*_SECRETS, *[(name, f"(?:^|[^A-Za-z0-9_-])(?:{p})", least) for name, p, least in _BOUNDED_SECRETS])
    bounded = ", ".join(f"'{name}'" for name, *_ in _BOUNDED_SECRETS)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT r, {n} AS k, {quoted(name)} AS kind, {least} AS least, regexp_extract_all(t, {quoted(p)}) AS found, string_split_regex(t, {quoted(p)}) AS between FROM d WHERE regexp_matches(t, {quoted(p)})"
        for n, (name, p, least) in enumerate(rules)
    )
    value = r"regexp_extract(m, '^[A-Za-z_]+[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lists AS ({kinds}),
each AS (SELECT r, k, kind, least, unnest(found) AS m, unnest(between[:len(found)]) AS b, unnest(range(len(found))) AS i FROM lists),
placed AS (SELECT r, k, kind, least, m, sum(length(b) + length(m)) OVER (PARTITION BY r, k ORDER BY i)::BIGINT AS stop FROM each),
bare AS (SELECT * REPLACE (CASE WHEN kind IN ({bounded}) AND regexp_matches(m, '^[^A-Za-z0-9_-]') THEN substr(m, 2) ELSE m END AS m) FROM placed),
spans AS (SELECT r, k, kind, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM bare WHERE length(CASE WHEN kind = 'assign' THEN {value} ELSE m END) >= least),
sums AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(span, ',' ORDER BY start, k) FILTER ({base}) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (r)"""


def op12_spelling(least_length: int = 5, least_count: int = 3, factor: int = 2, cut: int = 97) -> str:
    """The checksum byte by byte from a table of 256 remainders; near words through the words that one deletion leaves of them."""
    step = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384::BIGINT) ELSE {x} >> 1 END"
    levels = ", ".join(f"t{k} AS (SELECT n, {step.format(x='v')} AS v FROM t{k - 1})" for k in range(1, 9))
    return f"""
WITH RECURSIVE t0 AS (SELECT n, n::BIGINT AS v FROM range(256) x(n)), {levels}, tab AS (SELECT list(v ORDER BY n) AS tab FROM t8),
runs AS (SELECT doc_id, {_low("run")} AS run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, k, list_concat([4294967295::BIGINT], list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT)) AS b
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs)),
sums AS (SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, tab),
cuts AS (SELECT CASE WHEN h % {cut} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM sums),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cuts WHERE length(word) >= {least_length} GROUP BY word HAVING sum(k) >= {least_count}),
less AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
met AS (SELECT x.word AS a, y.word AS b, y.n FROM less x JOIN less y USING (rest) WHERE x.word <> y.word AND length(x.word) = length(y.word)
  AND len(list_filter(range(1, length(x.word) + 1), lambda i: substr(x.word, i::INT, 1) <> substr(y.word, i::INT, 1))) = 1),
other AS (SELECT l.word AS a, w.word AS b, w.n AS n_b, l.n AS n_a FROM less l JOIN words w ON l.rest = w.word),
near AS (SELECT DISTINCT a, b, n FROM (SELECT a, b, n FROM met UNION ALL SELECT a, b, n_b FROM other UNION ALL SELECT b, a, n_a FROM other)),
ranked AS (SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS k FROM near),
forms AS MATERIALIZED (SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= {factor} * words.n THEN b END AS form, CASE WHEN r.n >= {factor} * words.n THEN r.n END AS form_n FROM words LEFT JOIN ranked r ON a = word AND k = 1),
chain AS (SELECT word, word AS last, 0 AS far FROM forms UNION ALL SELECT chain.word, forms.form, far + 1 FROM chain JOIN forms ON forms.word = chain.last WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(last, far) AS root FROM chain GROUP BY word) USING (word)"""


def op13_divergence(least_docs: int = 30, prior: int = 5, scale: int = 1_000_000_000, most_terms: int = 50) -> str:
    """Every kept term with every group, group by group."""
    share = "CAST(1 + ({s}::HUGEINT * (({n})::HUGEINT + {p})) // (({t})::HUGEINT + {p} * v) AS BIGINT)"
    p = lambda n, t: share.format(s=scale, p=prior, n=n, t=t)
    terms = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
c AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all({_low("text")}, '{terms}')) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING count(*) >= {least_docs}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS t FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, sum(c.n) AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, coalesce(sum(n), 0) AS t FROM grps LEFT JOIN own USING (lang, source) GROUP BY ALL),
all_ AS MATERIALIZED (SELECT lang, source, term, coalesce(own.n, 0) AS n, {p("coalesce(own.n, 0)", "tot.t")} AS p, {p("kept.n", "langs.t")} AS q FROM tot JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN own USING (lang, source, term)),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM all_ x JOIN all_ y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM grps x JOIN grps y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM all_ WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {most_terms}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": op1_decontamination(),
        "op2_url_filter": op2_url_filter(),
        "op3_substring_dedup": op3_substring_dedup(),
        "op4_license_scan": licenses.oracle_sql(),
        "op5_jaccard_join": op5_jaccard_join(),
        "op6_warc": op6_warc(),
        "op8_mixing": op8_mixing(),
        "op9_secret_scan": op9_secret_scan(),
        "op12_spelling_variants": op12_spelling(),
        "op13_source_divergence": op13_divergence(),
    }
