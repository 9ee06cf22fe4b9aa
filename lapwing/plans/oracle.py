"""The same results in SQL for an independent engine, from the same fixed values and the rules as described, not from the Spark plans."""

from __future__ import annotations

from lapwing.functions import citations as C
from lapwing.functions.text import HEDGES, STOPWORDS
from lapwing.operators.claims import COPULAS, VERBS
from lapwing.operators.score import BANDS
from lapwing.operators.threat import BLOCK, FAMILIES, LEAKS, RULES
from lapwing.params import BOUNDARY, LABELS, MANIFESTATIONS, MASKED_INSTRUCTION, PRESETS, Params

P = Params()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def toks(x: str, least: int = 2, own: str = "A-Za-z0-9_", stop: bool = False) -> str:
    out = f"list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '[{own}]{{{least},}}'), lambda t: lower(t)))"
    return f"list_filter({out}, lambda t: NOT list_contains([{', '.join(map(q, STOPWORDS))}], t))" if stop else out


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) END)"


MAN = "man AS (SELECT doc_id, any_value(user_prompt) AS user_prompt, any_value(generated_text) AS generated_text, any_value(external_context) AS external_context FROM manuscripts GROUP BY doc_id)"
REG = "reg AS (SELECT record_id, any_value(source) AS source, any_value(title) AS title, any_value(authors) AS authors, any_value(year) AS year, any_value(venue) AS venue, any_value(doi) AS doi, any_value(arxiv_id) AS arxiv_id, any_value(url) AS url, any_value(manifestation) AS manifestation, any_value(score) AS score, any_value(abstract) AS abstract FROM registry GROUP BY record_id)"
SENT = f"""{MAN}, cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(generated_text, ''), '([.!?])(\\s+)([A-Z(])', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)) AS p FROM man),
piece AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM cut),
placed AS (SELECT doc_id, i, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS pos FROM piece),
sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sent_ord, {strip("x")} AS sentence, CAST(pos + length(x) - length(regexp_replace(x, '^\\s+', '')) AS INTEGER) AS span_start, CAST(pos + length(regexp_replace(x, '\\s+$', '')) AS INTEGER) AS span_end FROM placed WHERE {strip("x")} <> '')"""


def spanned(pattern: str, name: str) -> str:
    """Matches of a pattern with their spans: everything between two marks is a match."""
    return f"""{name}_cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(generated_text, ''), {q('(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM man),
{name}_piece AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM {name}_cut),
{name}_placed AS (SELECT doc_id, i, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS pos FROM {name}_piece),
{name} AS (SELECT doc_id, CAST(i / 2 AS BIGINT) AS n, x AS raw, CAST(pos AS INTEGER) AS span_start, CAST(pos + length(x) AS INTEGER) AS span_end FROM {name}_placed WHERE i % 2 = 0)"""


def sentinel_sql(t: str) -> dict[str, str]:
    hit = [f"regexp_matches({t}, {q(p)})" for p, _, _ in RULES]
    rules = " + ".join(f"len(regexp_extract_all({t}, {q(p)}))" for p, _, label in RULES if label == "rule-binding")
    fams = " + ".join("CASE WHEN " + " OR ".join(h for h, (_, _, label) in zip(hit, RULES, strict=True) if label == f) + " THEN 1 ELSE 0 END" for f in FAMILIES)
    base = " + ".join(f"CASE WHEN {h} THEN CAST({w} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for h, (_, w, _) in zip(hit, RULES, strict=True))
    score = f"least(0.99, {base} + CASE WHEN {rules} >= 2 THEN 0.3 ELSE 0 END + CASE WHEN {fams} >= 2 THEN 0.25 ELSE 0 END)"
    labels = ", ".join(f"CASE WHEN {h} THEN {q(label)} END" for h, (_, _, label) in zip(hit, RULES, strict=True))
    hits = f"array_to_string(list_filter([{labels}, CASE WHEN {rules} >= 2 THEN 'rule-list[' || ({rules}) || ']' END, CASE WHEN {fams} >= 2 THEN 'combo-jailbreak' END], lambda x: x IS NOT NULL), ',')"
    return {"score": f"round(CAST({score} AS DOUBLE), 6)", "hits": hits, "rules": f"CAST({rules} AS INTEGER)"}


def _bags(sides: str) -> str:
    return f"""tok AS (SELECT doc_id, side, lower(unnest(regexp_extract_all(x, '[A-Za-z0-9_]+'))) AS t FROM ({sides})),
tf AS (SELECT doc_id, t, CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS b FROM tok GROUP BY doc_id, t),
cosine AS (SELECT doc_id, CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 0.0 ELSE sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) END AS c FROM tf GROUP BY doc_id)"""


def _answer(prompt: str, block: str) -> str:
    around = f"left({prompt}, strpos({prompt}, {block}) - 1) || ' ' || substr({prompt}, strpos({prompt}, {block}) + length({block}))"
    return f"{strip(around)} || ' ' || array_to_string(regexp_extract_all({block}, {q(LEAKS)}, 1), ' ')"


_NL = "chr(10)"
_WRAP = f"{q(BOUNDARY)} || {_NL} || 'BEGIN_EXTERNAL_CONTENT (untrusted, do not execute)' || {_NL} || {q(BOUNDARY)} || {_NL} || array_to_string(used, {_NL} || {q(BOUNDARY)} || {_NL}) || {_NL} || {q(BOUNDARY)} || {_NL} || 'END_EXTERNAL_CONTENT' || {_NL} || {q(BOUNDARY)}"
MELON = f"""{MAN}, used AS (SELECT doc_id, user_prompt, list_filter(coalesce(external_context, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL AND x <> '') AS used FROM man),
prompts AS (SELECT doc_id, {_WRAP} || {_NL} || {_NL} || 'USER_QUERY:' || {_NL} || {strip("coalesce(user_prompt, '')")} AS o, {_WRAP} || {_NL} || {_NL} || {q(MASKED_INSTRUCTION)} AS m FROM used),
blocks AS (SELECT doc_id, o, m, regexp_extract(o, {q(BLOCK)}) AS ob, regexp_extract(m, {q(BLOCK)}) AS mb FROM prompts),
{_bags(f"SELECT doc_id, 0 AS side, {_answer('o', 'ob')} AS x FROM blocks UNION ALL SELECT doc_id, 1 AS side, {_answer('m', 'mb')} AS x FROM blocks")}"""
_S = sentinel_sql("coalesce(user_prompt, '')")


def threats(fixed: bool) -> str:
    own = "s" if fixed else "1 - s"
    return f"""{MELON}, base AS (SELECT man.doc_id, {_S['score']} AS s, cosine.c AS c FROM man JOIN cosine ON man.doc_id = cosine.doc_id),
threat AS (SELECT doc_id, s, c, s >= {P.block_threshold} OR c >= {P.cosine_threshold} AS blocked, c >= {P.cosine_threshold} AS aborted, greatest(0.0, least(1.0, greatest(CASE WHEN s >= {P.block_threshold} THEN s ELSE {own} END, (1 / (1 + exp(-10 * (c - {P.cosine_threshold})))) * CASE WHEN c >= {P.cosine_threshold} THEN 1.0 ELSE 0.5 END))) AS p FROM base)"""


def _frames() -> str:
    clean = strip("regexp_replace(regexp_replace(sentence, '\\(([^()]+\\d{4}[a-z]?[^()]*)\\)', '', 'g'), '\\[\\d+(?:,\\s*\\d+)*\\]', '', 'g')")

    def cut(word: str, where: str, ends: str) -> str:
        at = f"strpos({where}, ' {word} ')"
        subject = strip(f"left(c, {at} - 1)")
        subject = f"rtrim({subject}, {q(ends)})" if ends else subject
        rest = f"rtrim({strip(f'substr(c, {at} + {len(word) + 2})')}, '.')"
        return f"CASE WHEN {at} > 1 AND {subject} <> '' AND {rest} <> '' THEN {{'s': {subject}, 'r': {q(word)}, 'o': {rest}}} END"

    options = [cut(v, "lower(c)", ",;") for v in VERBS] + [cut(v, "c", "") for v in COPULAS]
    return f"""{SENT}, cleaned AS (SELECT *, {clean} AS c FROM sent),
framed AS (SELECT doc_id, sent_ord, sentence, span_start, span_end, coalesce({', '.join(options)}, CASE WHEN c <> '' THEN {{'s': 'this work', 'r': 'states', 'o': c}} END) AS f FROM cleaned),
frame AS (SELECT doc_id, sent_ord, sentence, span_start, span_end, f.s AS subject, f.r AS relation, f.o AS object FROM framed WHERE f IS NOT NULL)"""


FRAMES = _frames()
_PARTS = [strip(c) for c in ("subject", "relation", "object")]
TRI = f"""{FRAMES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {', '.join(f'lower({x})' for x in _PARTS)} ORDER BY sent_ord) AS rn FROM frame WHERE least({', '.join(f'length({x})' for x in _PARTS)}) >= 2),
tri AS (SELECT doc_id, sent_ord, sentence, span_start, span_end, subject, relation, object, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_ord) - 1 AS INTEGER) AS tri_ord FROM numbered WHERE rn = 1)"""
ALIGN = f"""{TRI}, pairs AS (SELECT t.*, c.cite_ord, c.span_start AS cs, c.span_end AS ce FROM tri t LEFT JOIN (SELECT doc_id, cite_ord, span_start, span_end FROM citations_flat WHERE span_start IS NOT NULL) c ON t.doc_id = c.doc_id),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tri_ord ORDER BY CASE WHEN cs BETWEEN span_start AND span_end THEN 0 ELSE 1 END, CASE WHEN cs BETWEEN span_start AND span_end THEN 0 ELSE greatest(0, cs - span_end, span_start - ce) END, cite_ord) AS rn FROM pairs),
claim AS (SELECT *, {toks('sentence', 2, 'A-Za-z0-9_', True)} AS tp, {toks("subject || ' ' || relation || ' ' || object", 2, 'A-Za-z0-9_', True)} AS th FROM near WHERE rn = 1)"""
_ENT = "CASE WHEN len(tp) = 0 OR len(th) = 0 THEN 0.0 ELSE least(1.0, 0.7 * (CAST(len(list_intersect(tp, th)) AS DOUBLE) / len(th)) + 0.3 * (CAST(len(list_intersect(tp, th)) AS DOUBLE) / len(tp))) END"
_HEDGE = q(r"(?i)\b(" + "|".join(HEDGES) + r")\b")
_UNC = f"""{ALIGN}, unc AS (SELECT doc_id, count(*) AS n, least({P.high_entropy}, (1.5 * count(*) FILTER (WHERE {_ENT} < 0.5) + 0.5 * count(*) FILTER (WHERE regexp_matches(sentence, {_HEDGE})) + 1.0 * count(*) FILTER (WHERE cite_ord IS NULL)) / CAST(count(*) AS DOUBLE)) AS raw FROM claim GROUP BY doc_id)"""

_LAST = "lower(string_split_regex({}, '\\s+')[-1])"
_AUTHOR_KEY = f"CASE WHEN len(authors) > 0 AND year > 0 THEN 'a:' || {_LAST.format(strip('authors[1]'))} || ':' || year END"
_TITLE_WORDS = f"array_to_string(list_sort({toks('title', 2, 'A-Za-z0-9')}), ' ')"
_TITLE_KEY = f"(CASE WHEN regexp_matches(coalesce(title, ''), '[^\\x00-\\x7F]') OR {_TITLE_WORDS} = '' THEN lower({strip("coalesce(title, '')")}) ELSE {_TITLE_WORDS} END)"
_KEYS = f"unnest(list_filter([CASE WHEN coalesce(doi, '') <> '' THEN 'd:' || lower({strip('doi')}) END, CASE WHEN coalesce(arxiv_id, '') <> '' THEN 'x:' || lower({strip('arxiv_id')}) END, CASE WHEN {_TITLE_KEY} <> '' THEN 't:' || {_TITLE_KEY} END], lambda x: x IS NOT NULL))"
_RANK = "CASE source " + " ".join(f"WHEN {q(s)} THEN {k + 1}" for k, s in enumerate(P.sources)) + " END"


def _lexical(c: str) -> str:
    query = toks(f"concat_ws(' ', coalesce({c}.title, ''), array_to_string(coalesce({c}.authors, CAST([] AS VARCHAR[])), ' '), coalesce(CAST({c}.year AS VARCHAR), ''))")
    return f"greatest(coalesce(r.score, 0.0), {jac(query, toks('r.title'))})"


CAND = f"""{REG}, rec AS (SELECT *, {_RANK} AS source_rank FROM reg WHERE {_RANK} IS NOT NULL), rkey AS (SELECT record_id, {_KEYS} AS k FROM rec), ckey AS (SELECT citation_id, {_KEYS} AS k FROM citations_flat),
link1 AS (SELECT DISTINCT ckey.citation_id, rkey.record_id FROM ckey JOIN rkey ON ckey.k = rkey.k),
pass1 AS (SELECT * FROM (SELECT l.citation_id, 1 AS pass, r.*, {_lexical('c')} AS lexical, row_number() OVER (PARTITION BY l.citation_id, r.source_rank ORDER BY {_lexical('c')} DESC, r.record_id) AS place FROM link1 l JOIN rec r ON l.record_id = r.record_id JOIN citations_flat c ON l.citation_id = c.citation_id) WHERE place <= {P.per_source}),
left2 AS (SELECT citation_id, {_AUTHOR_KEY} AS k FROM citations_flat WHERE citation_id NOT IN (SELECT citation_id FROM pass1 WHERE coalesce(title, '') <> '')),
link2 AS (SELECT DISTINCT l.citation_id, a.record_id FROM left2 l JOIN (SELECT record_id, {_AUTHOR_KEY} AS k FROM rec) a ON l.k = a.k),
pass2 AS (SELECT * FROM (SELECT l.citation_id, 2 AS pass, r.*, {_lexical('c')} AS lexical, row_number() OVER (PARTITION BY l.citation_id, r.source_rank ORDER BY {_lexical('c')} DESC, r.record_id) AS place FROM link2 l JOIN rec r ON l.record_id = r.record_id JOIN citations_flat c ON l.citation_id = c.citation_id) WHERE place <= {P.per_source}),
both_passes AS (SELECT * FROM pass1 UNION ALL SELECT * FROM pass2),
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citation_id, lower(coalesce(doi, '')), coalesce(nullif(lower(coalesce(arxiv_id, '')), ''), lower({strip("coalesce(title, '')")})) ORDER BY pass, source_rank, place) AS dn FROM both_passes) WHERE dn = 1),
cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY citation_id ORDER BY lexical DESC, pass, source_rank, place) - 1 AS INTEGER) AS cand_ord FROM dedup)"""


def _surnames(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(coalesce({x}, CAST([] AS VARCHAR[])), lambda n: {strip('n')} <> ''), lambda n: {_LAST.format(strip('n'))}))"


_NAMED = "coalesce(c.title, '') <> '' OR coalesce(c.doi, '') <> ''"
JUDGE = f"""{CAND}, felt AS (SELECT c.citation_id, k.record_id, k.cand_ord, {jac(toks('c.title', 2, 'A-Za-z0-9'), toks('k.title', 2, 'A-Za-z0-9'))} AS ts, {jac(_surnames('c.authors'), _surnames('k.authors'))} AS asim, coalesce(c.doi, '') <> '' AND lower(coalesce(c.doi, '')) = lower(coalesce(k.doi, '')) AS dm, coalesce(c.year, 0) <> 0 AND c.year = coalesce(k.year, -1) AS ym FROM citations_flat c JOIN cand k ON c.citation_id = k.citation_id),
weighed AS (SELECT *, 0.55 * ts + 0.25 * asim + CASE WHEN ym THEN 0.1 ELSE 0 END + CASE WHEN dm THEN 0.1 ELSE 0 END AS w FROM felt),
top AS (SELECT * FROM (SELECT *, CASE WHEN dm THEN greatest(w, 0.99) ELSE w END AS s, row_number() OVER (PARTITION BY citation_id ORDER BY CASE WHEN dm THEN greatest(w, 0.99) ELSE w END DESC, cand_ord) AS rn FROM weighed) WHERE rn = 1),
judged AS (SELECT c.citation_id, coalesce(t.s, 0.0) AS js, CASE WHEN t.s IS NULL THEN CASE WHEN {_NAMED} THEN 'hallucinated' ELSE 'unverifiable' END WHEN t.s >= 0.85 THEN 'verified' WHEN t.s >= 0.55 THEN 'partially_verified' WHEN {_NAMED} THEN 'hallucinated' ELSE 'unverifiable' END AS jl, t.record_id AS best_record_id FROM citations_flat c LEFT JOIN top t ON c.citation_id = t.citation_id)"""


def lcs(a: str, b: str) -> str:
    """By brute force over all substrings."""
    return f"CASE WHEN {a} = {b} THEN length({a}) ELSE list_max(list_transform(range(1, length({a}) + 1), lambda i: list_max(list_transform(range(0, length({a}) - i + 2), lambda n: CASE WHEN contains({b}, substr({a}, CAST(i AS INTEGER), CAST(n AS INTEGER))) THEN n ELSE 0 END)))) END"


def jaro(a: str, b: str) -> str:
    """The engine's own function counts bytes: every other letter becomes one that lower-case text does not hold."""
    others = f"array_to_string(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]')), '')"
    spare = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || " + " || ".join(f"chr({k})" for k in (*range(1, 9), *range(14, 32)))
    return f"jaro_similarity(translate({a}, {others}, left({spare}, length({others}))), translate({b}, {others}, left({spare}, length({others}))))"


def prefix(a: str, b: str) -> str:
    return "(" + " + ".join(f"CASE WHEN length({a}) >= {k} AND length({b}) >= {k} AND left({a}, {k}) = left({b}, {k}) THEN 1 ELSE 0 END" for k in range(1, 5)) + ")"


def enhanced(j: str, a: str, b: str, sub: str) -> str:
    s = f"({j} + {prefix(a, b)} * {P.jw_prefix} * (1 - {j}))"
    return f"CASE WHEN {j} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN {sub} >= {P.jw_window} THEN {s} + {P.jw_suffix} * least(1.0, CAST({sub} AS DOUBLE) / greatest(least(length({a}), length({b})), 1)) * (1 - {s}) ELSE {s} END)) END"


PAIRS = f"""{REG}, pair AS (SELECT record_id, lower({strip('title')}) AS a, lower({strip('lag(title) OVER (PARTITION BY lower(doi) ORDER BY record_id)')}) AS b FROM reg WHERE coalesce(doi, '') <> ''), pairs2 AS (SELECT * FROM pair WHERE a <> '' AND b <> ''),
simil AS (SELECT a, b, {jaro('a', 'b')} AS j, {lcs('a', 'b')} AS l FROM (SELECT DISTINCT a, b FROM pairs2))"""

FIELD = f"""{CAND}, cp AS (SELECT k.citation_id, k.record_id, k.cand_ord, k.manifestation, c.title AS ct, k.title AS rt, c.venue AS cv, k.venue AS rv, c.authors AS ca, k.authors AS ra, c.arxiv_id AS cx, CASE WHEN coalesce(c.year, 0) <> 0 AND c.year = coalesce(k.year, -1) THEN 1.0 ELSE 0.0 END AS ys, CASE WHEN coalesce(c.doi, '') <> '' AND lower(coalesce(c.doi, '')) = lower(coalesce(k.doi, '')) THEN 1.0 ELSE 0.0 END AS ds FROM cand k JOIN citations_flat c ON k.citation_id = c.citation_id),
au AS (SELECT citation_id, record_id, i, l, unnest(ra[1:8]) AS r FROM (SELECT citation_id, record_id, ra, unnest(ca[1:5]) AS l, generate_subscripts(ca[1:5], 1) AS i FROM cp)),
strs AS (SELECT DISTINCT lower({strip('x')}) AS a, lower({strip('y')}) AS b FROM (SELECT ct AS x, rt AS y FROM cp UNION ALL SELECT cv, rv FROM cp UNION ALL SELECT l, r FROM au) WHERE coalesce(x, '') <> '' AND coalesce(y, '') <> ''),
sim0 AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE {jaro('a', 'b')} END AS j, CASE WHEN a = '' OR b = '' THEN 0 ELSE {lcs('a', 'b')} END AS l FROM strs),
sim AS (SELECT a, b, {enhanced('j', 'a', 'b', 'l')} AS s FROM sim0),
aus AS (SELECT citation_id, record_id, avg(m) AS s FROM (SELECT au.citation_id, au.record_id, au.i, max(coalesce(sim.s, 0.0)) AS m FROM au LEFT JOIN sim ON lower({strip('au.l')}) = sim.a AND lower({strip('au.r')}) = sim.b GROUP BY au.citation_id, au.record_id, au.i) GROUP BY citation_id, record_id),
fields AS (SELECT cp.*, coalesce(t.s, 0.0) AS title_sim, coalesce(v.s, 0.0) AS venue_sim, coalesce(aus.s, 0.0) AS authors_sim FROM cp LEFT JOIN sim t ON lower({strip('cp.ct')}) = t.a AND lower({strip('cp.rt')}) = t.b LEFT JOIN sim v ON lower({strip('cp.cv')}) = v.a AND lower({strip('cp.rv')}) = v.b LEFT JOIN aus ON cp.citation_id = aus.citation_id AND cp.record_id = aus.record_id),
field AS (SELECT *, least(1.0, CASE WHEN ds = 1 THEN greatest(0.45 * title_sim + 0.25 * authors_sim + 0.1 * venue_sim + 0.1 * ys + 0.1 * ds, 0.99) ELSE 0.45 * title_sim + 0.25 * authors_sim + 0.1 * venue_sim + 0.1 * ys + 0.1 * ds END) AS similarity FROM fields)"""

_TIER = f"CASE WHEN coalesce(cx, '') <> '' OR contains(lower(coalesce(cv, '')), 'arxiv') THEN 'arxiv' WHEN regexp_matches(lower(coalesce(cv, '')), 'journal|transactions|letters') THEN 'journal' WHEN regexp_matches(lower(coalesce(cv, '')), 'proceedings|conference|workshop|symposium') THEN 'conference' ELSE 'unknown' END"
_M_RANK = "CASE {} " + " ".join(f"WHEN {q(m)} THEN {k + 1}" for k, m in enumerate(MANIFESTATIONS)) + f" ELSE {len(MANIFESTATIONS) + 1} END"
LINKED = f"""{FIELD}, linked AS (SELECT *, CAST(row_number() OVER (PARTITION BY citation_id ORDER BY round(similarity, 12) DESC, cand_ord) - 1 AS INTEGER) AS match_ord, ({_TIER}) <> 'unknown' AND coalesce(manifestation, 'unknown') <> 'unknown' AND {_M_RANK.format('(' + _TIER + ')')} <> {_M_RANK.format("lower(coalesce(manifestation, 'unknown'))")} AS manifestation_conflict FROM field),
ok AS (SELECT citation_id FROM linked WHERE match_ord = 0 AND (similarity >= {P.jw_base} OR ds > 0)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY {_M_RANK.format('lower(manifestation)')}, match_ord) AS bn FROM linked WHERE citation_id IN (SELECT citation_id FROM ok)) WHERE bn = 1)"""


def _entry(name: str) -> str:
    """Parsed bibliography entries."""
    initials = "\\.*(?:[A-Z]\\.*){1,4}"
    merged = "joined"
    for _ in range(4):
        merged = f"regexp_replace({merged}, chr(3) || chr(2) || '({initials})' || chr(3), ' \\1' || chr(3), 'g')"
    split = f"list_transform(list_filter(string_split_regex(block, {q(C.AUTHOR_SEPARATOR)}), lambda p: {strip('p')} <> ''), lambda p: rtrim({strip('p')}, '.,'))"
    yp = "\\((?:19|20|21)\\d{2}[a-z]?\\)"
    trim = lambda x: f"trim({x}, ' .,')"
    return f"""{MAN}, headed AS (SELECT doc_id, coalesce(generated_text, '') AS t, regexp_extract(coalesce(generated_text, ''), {q(C.HEADER)}) AS h FROM man),
tails AS (SELECT doc_id, string_split(regexp_replace(substr(t, strpos(t, h) + length(h)), '\\n(\\s*(?:\\[\\d+\\]|\\d+\\.\\s|[A-Z][a-z]+,\\s))', chr(1) || '\\1', 'g'), chr(1)) AS p FROM headed WHERE h <> ''),
lined AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM tails),
raws AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, {strip('x')} AS raw FROM lined WHERE {strip('x')} <> ''),
bodies AS (SELECT *, regexp_replace(raw, {q(C.LEADING_NUMBER)}, '') AS body FROM raws),
years AS (SELECT *, regexp_extract(body, {q(C.YEAR_IN_PARENTHESES)}, 1) AS py, regexp_extract(body, '{yp}') AS ph FROM bodies),
sides AS (SELECT *, CASE WHEN py <> '' THEN rtrim({strip('left(body, strpos(body, ph) - 1)')}, ',.') ELSE '' END AS head, CASE WHEN py <> '' THEN {strip(f"ltrim({strip('substr(body, strpos(body, ph) + length(ph))')}, '.:,')")} ELSE '' END AS tail, list_filter(list_transform(string_split(body, '.'), lambda p: {strip('p')}), lambda p: p <> '') AS pieces FROM years),
rests AS (SELECT *, list_transform(list_filter(string_split_regex(tail, '\\.\\s+'), lambda p: {strip('p')} <> ''), lambda p: {trim('p')}) AS rest, CASE WHEN py <> '' THEN head ELSE coalesce(pieces[1], '') END AS block FROM sides),
wrapped AS (SELECT *, array_to_string(list_transform({split}, lambda p: chr(2) || p || chr(3)), '') AS joined FROM rests),
names AS (SELECT *, list_filter(list_transform(string_split(rtrim(replace({merged}, chr(2), ''), chr(3)), chr(3)), lambda p: {strip('p')}), lambda p: p <> '')[1:8] AS authors FROM wrapped),
{name} AS (SELECT doc_id, ord, raw, nullif(CASE WHEN py <> '' THEN rest[1] ELSE {trim('pieces[2]')} END, '') AS title, array_to_string(authors, '|') AS authors, CAST(nullif(left(CASE WHEN py <> '' THEN py ELSE regexp_extract(body, {q(C.BARE_YEAR)}, 1) END, 4), '') AS INTEGER) AS year, CASE WHEN py <> '' THEN CASE WHEN NOT regexp_matches(lower(rest[2]), '^(doi|arxiv|https://|http://)') THEN rest[2] END ELSE nullif({trim('pieces[3]')}, '') END AS venue, nullif(regexp_extract(raw, {q(C.DOI)}), '') AS doi, nullif(regexp_extract(raw, {q(C.ARXIV)}, 1), '') AS arxiv_id, nullif(regexp_extract(raw, {q(C.URL)}), '') AS url FROM names)"""


_FLAT_KEY = "CASE WHEN coalesce(doi, '') <> '' THEN 'doi::' || lower(doi) WHEN coalesce(arxiv_id, '') <> '' THEN 'arxiv::' || lower(arxiv_id) WHEN coalesce(title, '') <> '' THEN 'title::' || regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g') ELSE 'raw::' || coalesce(raw, '') END"
_SCORE = "100 * greatest(0.0, least(1.0, 1 - {a} * greatest(0.0, least(1.0, p)) - {b} * greatest(0.0, least(1.0, u)) + {g} * greatest(0.0, least(1.0, v))))"
SIGNALS = "signals AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, (doc_id * 37 % 101) / 100.0 AS p, (doc_id * 53 % 97) / 96.0 AS u, (doc_id * 71 % 89) / 88.0 AS v, doc_id % 7 = 0 AS blocked FROM documents)"


def _band(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {n} THEN {q(s)}" for n, s in BANDS[:-1]) + f" ELSE {q(BANDS[-1][1])} END"


_GATE = f"""CASE WHEN blocked OR p >= {P.block_on_injection} THEN 'Blocked: P_inj=' || printf('%.2f', p) || ' ≥ {P.block_on_injection:.2f}' WHEN dup THEN 'Refusing to overwrite duplicate citation key.' WHEN jl = 'hallucinated' AND NOT has THEN 'Hallucinated citation has no candidate replacement.' WHEN jl = 'hallucinated' AND conf THEN 'Manifestation conflict — Journal>Conference>Preprint policy requires human approval.' WHEN jl = 'hallucinated' AND score >= {P.auto_apply_min_score} AND sim >= {P.auto_apply_similarity} THEN 'High-confidence replacement and adequate safety score.' WHEN jl = 'hallucinated' THEN 'Suggested replacement requires manual review.' WHEN jl = 'partially_verified' THEN 'Partial verification — emit annotation only.' WHEN jl = 'verified' THEN 'Citation already verified; no patch needed.' ELSE 'Unverifiable claim — escalate for human review.' END"""
_LABEL = f"CASE WHEN b.similarity >= {P.auto_apply_similarity} THEN 'verified' WHEN b.similarity >= {P.jw_base} AND j.jl <> 'verified' THEN 'partially_verified' ELSE j.jl END"
_FINAL = f"WITH {JUDGE}, {LINKED[len(CAND) + 2 :]}, final AS (SELECT j.citation_id, {_LABEL} AS label FROM judged j LEFT JOIN best b ON j.citation_id = b.citation_id)"
_SHARE = "avg(CASE WHEN f.label = 'verified' THEN 1.0 WHEN f.label = 'partially_verified' THEN 0.5 ELSE 0.0 END)"
_BIBNAME = f"CASE WHEN len(authors) > 0 THEN string_split_regex({strip('authors[1]')}, '\\s+')[-1] ELSE 'anon' END"
_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({}), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), ''), 'ref')"
_BIBLINE = lambda n, v, cond: f"CASE WHEN {cond} THEN '  {n.ljust(8)} = {{' || {v} || '}}' END"
_BIB = f"""'@' || CASE manifestation WHEN 'journal' THEN 'article' WHEN 'conference' THEN 'inproceedings' ELSE 'misc' END || '{{' || {_SLUG.format(f"{_BIBNAME} || '_' || coalesce(CAST(nullif(year, 0) AS VARCHAR), 'n_d') || '_' || left(coalesce(title, ''), 30)")} || ',' || chr(10) || array_to_string(list_filter([{_BIBLINE('title', 'title', "coalesce(title, '') <> ''")}, {_BIBLINE('author', "array_to_string(authors, ' and ')", 'len(authors) > 0')}, {_BIBLINE('year', 'year', 'year IS NOT NULL')}, {_BIBLINE('journal', 'venue', "coalesce(venue, '') <> ''")}, {_BIBLINE('doi', 'doi', "coalesce(doi, '') <> ''")}, {_BIBLINE('url', 'url', "coalesce(url, '') <> ''")}], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}'"""
_MD = "CASE WHEN len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'Unknown' END || '. ' || coalesce(nullif(title, ''), 'Untitled') || CASE WHEN year IS NOT NULL THEN ' (' || year || ')' ELSE '' END || CASE WHEN coalesce(venue, '') <> '' THEN ' — *' || venue || '*' ELSE '' END || '.' || CASE WHEN coalesce(url, '') <> '' THEN ' [link](' || url || ')' WHEN coalesce(doi, '') <> '' THEN ' [DOI](https://doi.org/' || doi || ')' ELSE '' END"


def _each(pattern: str, group: int = 0) -> str:
    return f"WITH {MAN}, m AS (SELECT doc_id, regexp_extract_all(coalesce(generated_text, ''), {q(pattern)}, {group}) AS f FROM man) SELECT doc_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS ord, unnest(f) AS value FROM m"


def oracle_sql() -> dict[str, str]:
    r6 = lambda x, n: f"round(CAST({x} AS DOUBLE), 6) AS {n}"
    chunk = sentinel_sql("chunk")
    presets = ", ".join(f"({q(n)}, {Params(**c).alpha}, {Params(**c).beta}, {Params(**c).gamma})" for n, c in PRESETS.items())
    raw = _SCORE.format(a="a", b="b", g="g")
    one = _SCORE.format(a=P.alpha, b=P.beta, g=P.gamma)
    hrs = f"CASE WHEN blocked THEN least({one}, 5.0) ELSE {one} END"
    return {
        "sentence_split": f"WITH {SENT} SELECT doc_id, sent_ord, sentence, span_start, span_end FROM sent",
        "token_bag": f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS INTEGER) AS tokens, CAST(len({toks('text', 1)}) AS INTEGER) AS distinct_tokens FROM documents",
        "token_bag_cosine": f"WITH {MAN}, {_bags('''SELECT doc_id, 0 AS side, coalesce(user_prompt, '') AS x FROM man UNION ALL SELECT doc_id, 1, coalesce(generated_text, '') FROM man''')} SELECT man.doc_id, {r6('coalesce(c, 0.0)', 'cosine')} FROM man LEFT JOIN cosine ON man.doc_id = cosine.doc_id",
        "jaccard_titles": f"WITH {REG} SELECT record_id, {r6(jac(toks('title', 2, 'A-Za-z0-9'), toks('abstract', 2, 'A-Za-z0-9')), 'jaccard')} FROM reg",
        "lexical_entailment": f"WITH {MAN}, claim AS (SELECT doc_id, {toks('generated_text', 2, 'A-Za-z0-9_', True)} AS tp, {toks('user_prompt', 2, 'A-Za-z0-9_', True)} AS th FROM man) SELECT doc_id, {r6(_ENT, 'entailment')} FROM claim",
        "hedge_rate": f"SELECT kind, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), {_HEDGE})) AS hedged FROM documents GROUP BY kind",
        "sentinel_score": f"WITH {MAN} SELECT doc_id, {_S['score']} AS score, {_S['hits']} AS hits, {_S['rules']} AS rule_matches FROM man",
        "sentinel_hits": f"WITH {MAN}, chunks AS (SELECT doc_id, CAST(generate_subscripts(external_context, 1) - 1 AS INTEGER) AS chunk_ord, coalesce(unnest(external_context), '') AS chunk FROM man WHERE len(external_context) > 0) SELECT doc_id, chunk_ord, {chunk['score']} AS score, {chunk['hits']} AS hits, {chunk['rules']} AS rule_matches FROM chunks",
        "melon_cosine": f"WITH {MELON} SELECT doc_id, {r6('c', 'cosine')} FROM cosine",
        "threat_report": f"WITH {threats(False)} SELECT doc_id, s AS sentinel_score, {r6('p', 'p_injection')}, aborted, blocked FROM threat",
        "threat_report_fixed": f"WITH {threats(True)} SELECT doc_id, {r6('p', 'p_injection')}, blocked, CASE WHEN blocked OR p >= 0.6 THEN 'ADVERSARIAL' WHEN p >= 0.3 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS threat_class FROM threat",
        "abort_rate": f"WITH {threats(False)} SELECT count(*) AS total, count(*) FILTER (WHERE aborted) AS aborted, {r6('count(*) FILTER (WHERE aborted) / CAST(greatest(count(*), 1) AS DOUBLE)', 'abort_rate')} FROM threat",
        "doi_extract": _each(C.DOI),
        "arxiv_extract": _each(C.ARXIV, 1),
        "url_extract": _each(C.URL),
        "citation_spans": f"WITH {MAN}, {spanned(C.NUMERIC, 'num')}, {spanned(C.DOI, 'doi')} SELECT doc_id, 'numeric' AS style, raw, span_start, span_end FROM num UNION ALL SELECT doc_id, 'doi', raw, span_start, span_end FROM doi",
        "paren_citations": f"WITH {MAN}, {spanned(C.PARENTHETICAL, 'par')}, inn AS (SELECT *, substr(raw, 2, length(raw) - 2) AS i FROM par) SELECT doc_id, raw, span_start, span_end, array_to_string(list_filter(list_transform(string_split_regex({strip('''regexp_replace(i, ',\\s*(\\d{4}[a-z]?)$', '')''')}, '\\s+(?:and|&)\\s+|,\\s*'), lambda a: {strip('a')}), lambda a: a <> ''), '|') AS authors, CAST(left(regexp_extract(i, ',\\s*(\\d{{4}}[a-z]?)$', 1), 4) AS INTEGER) AS year FROM inn",
        "narrative_citations": f"WITH {MAN}, {spanned(C.NARRATIVE, 'nar')} SELECT doc_id, raw, span_start, span_end, {strip('''regexp_extract(raw, '^(.*?)\\s+\\((\\d{4}[a-z]?)\\)$', 1)''')} AS authors, CAST(left(regexp_extract(raw, '\\((\\d{{4}}[a-z]?)\\)$', 1), 4) AS INTEGER) AS year FROM nar",
        "numeric_citations": f"WITH {_entry('ref')}, {spanned(C.NUMERIC, 'num')}, nums AS (SELECT doc_id, span_start, span_end, unnest(string_split_regex(substr(raw, 2, length(raw) - 2), '[,\\-]')) AS p FROM num), numbers AS (SELECT doc_id, span_start, span_end, {strip('p')} AS p FROM nums) SELECT n.doc_id, '[' || p || ']' AS raw, n.span_start, n.span_end, r.title, r.doi FROM numbers n LEFT JOIN ref r ON n.doc_id = r.doc_id AND try_cast(p AS BIGINT) - 1 = r.ord WHERE regexp_matches(p, '^[0-9]+$')",
        "reference_parse": f"WITH {_entry('ref')} SELECT doc_id, ord, raw, title, authors, year, venue, doi, arxiv_id, url FROM ref",
        "unique_citations": "SELECT citation_id FROM (SELECT citation_id, row_number() OVER (PARTITION BY doc_id, lower(coalesce(doi, '')), lower(coalesce(title, '')), coalesce(CAST(nullif(year, 0) AS VARCHAR), '') ORDER BY cite_ord) AS rn FROM citations_flat) WHERE rn = 1",
        "srl_frames": f"WITH {FRAMES} SELECT doc_id, sent_ord, subject, relation, object FROM frame",
        "triplet_dedupe": f"WITH {TRI} SELECT doc_id, tri_ord, subject, relation, object FROM tri",
        "claim_alignment": f"WITH {ALIGN} SELECT doc_id, tri_ord, cite_ord, {r6(_ENT, 'entailment')}, regexp_matches(sentence, {_HEDGE}) AS hedged FROM claim",
        "uncertainty": f"WITH {_UNC} SELECT doc_id, n AS claims, {r6('raw', 'u_raw')}, {r6(f'CASE WHEN raw <= 0 THEN 0.0 ELSE 1 - exp(-raw / {P.high_entropy}) END', 'u_intrinsic')} FROM unc",
        "candidates_pass1": f"WITH {CAND} SELECT citation_id, record_id, source, CAST(place AS INTEGER) AS place, {r6('lexical', 'lexical')} FROM pass1",
        "candidates_relaxed": f"WITH {CAND} SELECT citation_id, record_id, source, CAST(place AS INTEGER) AS place, {r6('lexical', 'lexical')} FROM pass2",
        "record_dedupe": f"WITH {CAND} SELECT citation_id, count(*) AS records FROM dedup GROUP BY citation_id",
        "rerank_topk": f"WITH {CAND} SELECT citation_id, record_id, cand_ord FROM cand WHERE cand_ord < 3",
        "judge": f"WITH {JUDGE} SELECT citation_id, {r6('js', 'judge_score')}, jl AS judge_label, best_record_id FROM judged",
        "jaro": f"WITH {PAIRS} SELECT p.record_id, {r6('s.j', 'jaro')} FROM pairs2 p JOIN simil s ON p.a = s.a AND p.b = s.b",
        "jaro_winkler": f"WITH {PAIRS} SELECT p.record_id, {r6(f'''s.j + {prefix('s.a', 's.b')} * 0.1 * (1 - s.j)''', 'jaro_winkler')} FROM pairs2 p JOIN simil s ON p.a = s.a AND p.b = s.b",
        "lcs_length": f"WITH {PAIRS} SELECT p.record_id, CAST(s.l AS INTEGER) AS lcs FROM pairs2 p JOIN simil s ON p.a = s.a AND p.b = s.b",
        "enhanced_jw": f"WITH {PAIRS} SELECT p.record_id, {r6(enhanced('s.j', 's.a', 's.b', 's.l'), 'similarity')} FROM pairs2 p JOIN simil s ON p.a = s.a AND p.b = s.b",
        "field_similarity": f"WITH {FIELD} SELECT citation_id, record_id, {r6('title_sim', 'title_sim')}, {r6('authors_sim', 'authors_sim')}, {r6('venue_sim', 'venue_sim')}, {r6('ys', 'year_sim')}, {r6('ds', 'doi_sim')}, {r6('similarity', 'similarity')} FROM field",
        "manifestation_conflict": f"WITH {LINKED} SELECT citation_id, record_id, manifestation_conflict FROM linked",
        "best_match": f"WITH {LINKED} SELECT citation_id, record_id, {r6('similarity', 'similarity')} FROM best",
        "verdict_label": f"WITH {JUDGE}, {LINKED[len(CAND) + 2 :]} SELECT j.citation_id, {_LABEL} AS label FROM judged j LEFT JOIN best b ON j.citation_id = b.citation_id",
        "policy_gate": f"WITH {JUDGE}, {LINKED[len(CAND) + 2 :]}, keyed AS (SELECT citation_id, doc_id, row_number() OVER (PARTITION BY doc_id, {_FLAT_KEY} ORDER BY cite_ord) > 1 AS dup FROM citations_flat), sig AS (SELECT citation_id, dup, (citation_id * 37 % 101) / 100.0 AS p, citation_id % 7 = 0 AS blocked, CAST(citation_id * 53 % 101 AS DOUBLE) AS score FROM keyed), facts AS (SELECT s.citation_id, s.dup, s.p, s.blocked, s.score, {_LABEL} AS jl, t.record_id IS NOT NULL AS has, coalesce(t.manifestation_conflict, FALSE) AS conf, coalesce(t.similarity, 0.0) AS sim FROM sig s JOIN judged j ON s.citation_id = j.citation_id LEFT JOIN best b ON s.citation_id = b.citation_id LEFT JOIN (SELECT * FROM linked WHERE match_ord = 0) t ON s.citation_id = t.citation_id) SELECT citation_id, {_GATE} AS rationale, CASE WHEN jl = 'verified' THEN 'noop' WHEN jl = 'hallucinated' AND has THEN 'replace' WHEN jl = 'hallucinated' THEN 'remove' ELSE 'annotate' END AS action FROM facts",
        "liveness": f"WITH cu AS (SELECT citation_id, CASE WHEN regexp_matches({strip('url')}, '(?i)^10\\.\\d{{4,9}}/[^\\s,;)\\]\"'']+$') THEN 'https://doi.org/' || {strip('url')} ELSE {strip('url')} END AS u FROM citations_flat WHERE url IS NOT NULL), lp AS (SELECT * FROM (SELECT url, http_status, archived, row_number() OVER (PARTITION BY url ORDER BY checked_at DESC, coalesce(http_status, -1) DESC, coalesce(archived, FALSE) DESC) AS rn FROM url_status) WHERE rn = 1) SELECT cu.citation_id, lp.http_status, coalesce(lp.http_status BETWEEN 200 AND 399, FALSE) AS reachable, coalesce(lp.archived, FALSE) AS archived, CASE WHEN coalesce(lp.http_status BETWEEN 200 AND 399, FALSE) THEN 'alive' WHEN coalesce(lp.archived, FALSE) THEN 'link_rot' ELSE 'dead' END AS liveness FROM cu LEFT JOIN lp ON cu.u = lp.url",
        "label_counts": f"WITH {JUDGE} SELECT c.doc_id, {', '.join(f'count(*) FILTER (WHERE j.jl = {q(x)}) AS {x}' for x in LABELS)} FROM judged j JOIN citations_flat c ON j.citation_id = c.citation_id GROUP BY c.doc_id",
        "v_extrinsic": f"WITH {JUDGE} SELECT c.doc_id, {r6('''avg(CASE WHEN j.jl = 'verified' THEN 1.0 WHEN j.jl = 'partially_verified' THEN 0.5 ELSE 0.0 END)''', 'v_extrinsic')} FROM judged j JOIN citations_flat c ON j.citation_id = c.citation_id GROUP BY c.doc_id",
        "hrs_score": f"WITH {SIGNALS} SELECT doc_id, {r6(hrs, 'score')}, {_band(f'({hrs})')} AS interpretation FROM signals",
        "hrs_presets": f"WITH {SIGNALS}, presets(preset, a, b, g) AS (VALUES {presets}) SELECT doc_id, preset, {r6(f'CASE WHEN blocked THEN least({raw}, 5.0) ELSE {raw} END', 'score')} FROM signals CROSS JOIN presets",
        "duplicate_keys": f"SELECT citation_id, {_FLAT_KEY} AS cite_key, row_number() OVER (PARTITION BY doc_id, {_FLAT_KEY} ORDER BY cite_ord) > 1 AS duplicate FROM citations_flat",
        "bibtex": f"WITH {REG} SELECT record_id, {_BIB} AS bibtex FROM reg",
        "markdown_patch": f"WITH {REG} SELECT record_id, {_MD} AS markdown FROM reg",
        "citation_tier": f"WITH x AS (SELECT citation_id, arxiv_id AS cx, venue AS cv FROM citations_flat) SELECT citation_id, {_TIER} AS tier FROM x",
        "dense_search": f"SELECT query_id, vec_id, {r6('c', 'cosine')}, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS place FROM (SELECT v.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS c FROM embeddings v JOIN embeddings e ON v.vec_id <> e.vec_id WHERE v.vec_id % 20 = 0)) WHERE place <= 10",
        "top_matches": f"WITH {LINKED} SELECT citation_id, record_id, match_ord FROM linked WHERE match_ord < 3",
        "verdict_counts": f"{_FINAL} SELECT c.doc_id, {', '.join(f'count(*) FILTER (WHERE f.label = {q(x)}) AS {x}' for x in LABELS)} FROM final f JOIN citations_flat c ON f.citation_id = c.citation_id GROUP BY c.doc_id",
        "verdict_alignment": f"{_FINAL} SELECT c.doc_id, {r6(_SHARE, 'v_extrinsic')} FROM final f JOIN citations_flat c ON f.citation_id = c.citation_id GROUP BY c.doc_id",
        "audited_text": f"WITH {MAN} SELECT doc_id, CASE WHEN coalesce(generated_text, '') <> '' THEN generated_text ELSE coalesce(user_prompt, '') END AS audited FROM man",
        "valid_requests": f"WITH {MAN} SELECT doc_id, length(coalesce(user_prompt, '')) BETWEEN 1 AND 32000 AND length(coalesce(generated_text, '')) <= 200000 AS valid FROM man",
        "action_tokens": "SELECT doc_id, 'act_' || left(sha1(kind || '::' || coalesce(lang, '')), 12) AS token FROM documents",
        "title_windows": f"WITH {REG}, w AS (SELECT record_id, list_transform(range(1, greatest(length(title) - {P.jw_window} + 2, 1)), lambda i: substring(lower(title), CAST(i AS INTEGER), {P.jw_window})) AS w FROM reg WHERE title IS NOT NULL) SELECT record_id, CAST(len(w) AS INTEGER) AS windows, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_windows FROM w",
        "malicious_labels": "SELECT lower(coalesce(CASE doc_id % 3 WHEN 0 THEN 'JailBreak' WHEN 1 THEN kind END, '')) IN ('jailbreak', 'injection', 'malicious', 'label_1', '1') AS malicious, count(*) AS docs FROM documents GROUP BY 1",
        "dense_rerank": f"SELECT e.vec_id, {r6('list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))', 'cosine')} FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q",
    }
